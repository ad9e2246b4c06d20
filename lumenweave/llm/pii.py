r"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Base entities come from fixed forms (email, ip, card, phone).  They are the seeds.  Every word that holds a digit
or an at sign is an instance; it makes lexical patterns of its context and its spelling.  Contexts: the two words
before it, the word on either side, the two words after it, the word before, the word after, and those with one
word between.  Spellings: rough (an at sign, letters and digits, digits alone), close (runs of letters and of
digits as one, other signs as they are) and exact (the same with the length of each run of digits).  Every
context goes with a spelling, and the closer two spellings also stand alone.

Spark scores the bipartite pattern-instance graph in rounds, until no pattern is added (``ROUNDS`` at most).  An
instance's seed confidence is the share of its places that lie in base entities of a kind.  A pattern's
confidence for a kind is the sum of its distinct instances' confidences, over their number and one; it is strong
from ``TAU`` on, if the sum is ``MIN_SEEDS`` or more.  An instance learns the best confidence among its strong patterns,
and so makes further patterns strong in the next round.  Words in strong patterns become spans of that kind.

One pass reads the texts and writes small rows; all graph steps aggregate before they shuffle, so a
pattern or instance that fills a third of all rows stays one row per task.  Texts are not shuffled, but for
those that ``redact`` changes, in pieces.  Context reaches ``CONTEXT`` characters of the text and of the instances on
either side; of a longer word next to an instance it sees the nearer part.

Fixed forms are matched with possessive groups, so runs of any length neither recurse nor backtrack;
a look-behind keeps the search linear and changes no leftmost match.

Defined cases: null text is empty and has no spans; repeated rows get equal spans; an empty table gives
an empty table; overlapping spans of different kinds are all reported and redacted as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, broadcast_if_small, row_key, save

KINDS = ("email", "ip", "card", "phone")
# The forms of the base entities.
EMAIL_CHARS = r"A-Za-z0-9._%+-"
FORMS = {
    "email": rf"(?:(?<![{EMAIL_CHARS}])|\G)[{EMAIL_CHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap test that a text may hold the form at all.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
MIN_SEEDS, TAU, ROUNDS, CONTEXT = 5, 0.8, 6, 80
BROADCAST_ROWS = 200_000
STRETCH = 512
#: Code points of text that are redacted at once.
PIECE = 512
SPACE = r"\x20\x09-\x0D"
#: A word with a digit or at sign; from a word's start the scan is linear.
INSTANCE = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"


#: Words of a context, and the contexts that go with a spelling ("alone" has none).
SIDES = {"before": ("l2", "l1"), "around": ("l1", "r1"), "after": ("r1", "r2"), "left": ("l1",), "right": ("r1",), "left gap": ("l2",), "right gap": ("r2",), "alone": ()}
PATTERNS = {"rough": ("before", "around", "after"), "close": tuple(SIDES), "exact": ("left", "right", "alone")}


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    digits = F.regexp_replace(m, "[^0-9]+", "")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":
        n = F.length(digits)

        def luhn(acc, i):
            x = F.substring(digits, n - i, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

        return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), luhn) % 10 == 0).otherwise(False)
    return F.lit(True)


#: Matches that are placed at once; bounds the copying where a text has very many.
RUN = 256
HIT = "array<struct<s:int,e:int,m:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """Array of structs (p, m): each leftmost non-overlapping match with the piece of text before it.

    The last holds the piece after all matches, and an empty match.
    """
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(F.arrays_zip(pieces.alias("p"), hits.alias("m")), lambda x: F.struct(x["p"].alias("p"), F.coalesce(x["m"], F.lit("")).alias("m")))


def _run_starts(matches: str) -> Column:
    """Where each run of matches begins, in code points: running sums over whole runs."""
    run = lambda i: F.slice(matches, i * RUN + 1, F.lit(RUN))
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int")), lambda i: F.aggregate(run(i), F.lit(0), lambda a, x: a + F.length(x["p"]) + F.length(x["m"])))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sums, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def _placed(matches: str, starts: str) -> Column:
    """Array of structs (s, e, m) of the matches: match k starts after the pieces up to k and the matches before."""

    def step(acc, x):
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    one = lambda at, i: F.aggregate(F.slice(matches, i * RUN + 1, F.lit(RUN)), F.struct(at.alias("at"), F.array().cast(HIT).alias("out")), step, lambda acc: acc["out"])
    return F.slice(F.flatten(F.transform(starts, one)), F.lit(1), F.size(matches) - 1)


def located(rows: DataFrame, text: str, wanted: dict) -> DataFrame:
    """``rows`` with a column for each name in ``wanted`` (pattern, condition): an array of structs (start, end, match).

    A column named with ``_m`` more holds the matches with the pieces between them.

    Each step is a projection of its own, so no expression is evaluated twice.
    """
    for name, (pattern, may) in wanted.items():
        rows = rows.withColumn(f"{name}_m", F.when(may, _matches(F.col(text), pattern)))
    for name in wanted:
        some = F.size(f"{name}_m") > 1
        rows = rows.withColumn(f"{name}_o", F.when(some, _run_starts(f"{name}_m")))
    for name in wanted:
        rows = rows.withColumn(name, F.when(F.col(f"{name}_o").isNotNull(), _placed(f"{name}_m", f"{name}_o")).otherwise(F.array().cast(HIT)))
    return rows.drop(*[f"{n}_o" for n in wanted])


def _tagged(hits: str, i: int) -> Column:
    """The valid ones of a kind's matches, as structs (kind number, start, end)."""
    return F.transform(F.filter(hits, lambda x: _valid(KINDS[i], x["m"])), lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, key, ``base`` (array of kind number, start, end) and ``words`` (instances with context)."""
    t = P + "t"
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias(P + "key"), F.coalesce(F.col("text"), F.lit("")).alias(t))
    rows = rows.withColumn(P + "digit", F.col(t).rlike("[0-9]"))
    has = lambda k: F.col(t).contains(HINTS[k]) & (F.lit(True) if k == "email" else F.col(P + "digit")) & F.col(t).rlike(FORMS[k])
    wanted = {P + k: (FORMS[k], has(k)) for k in KINDS} | {P + "in": (INSTANCE, F.col(P + "digit") | F.col(t).contains("@"))}
    rows = located(rows, t, wanted)
    base = F.concat(*[_tagged(P + k, i) for i, k in enumerate(KINDS)])
    # Context comes from the pieces and matches next to a match, at most ``CONTEXT`` characters of each.
    m = P + "in_m"
    piece = lambda i, end: F.coalesce(F.substring(F.get(m, i)["p"], -CONTEXT if end else 1, CONTEXT), F.lit(""))
    match = lambda i, end: F.coalesce(F.substring(F.get(m, i)["m"], -CONTEXT if end else 1, CONTEXT), F.lit(""))
    before = lambda i: F.concat(piece(i - 1, True), match(i - 1, True), piece(i, True))
    after = lambda i: F.concat(piece(i + 1, False), match(i + 1, False), piece(i + 2, False))
    around = lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), before(i).alias("l"), after(i).alias("r"))
    return rows.select("doc_id", P + "key", base.alias("base"), F.transform(P + "in", around).alias("words"))


def _occurrences(scanned: DataFrame) -> DataFrame:
    """One row per instance in its place: key, bare span, instance id, pattern ids, seed kind (or null)."""
    x = F.col("x")
    lead = F.length(F.regexp_extract(x["m"], r"^[^A-Za-z0-9+@]*", 0))
    tail = F.length(F.regexp_extract(x["m"], r"[^A-Za-z0-9]*$", 0))
    rows = scanned.select(P + "key", F.explode("words").alias("x")).select(P + "key", "x", (x["s"] + lead).alias("s"), (x["e"] - tail).alias("e")).filter("s < e")
    bare = F.substring(x["m"], F.col("s") - x["s"] + 1, F.col("e") - F.col("s"))
    word = lambda side, p: F.lower(F.regexp_extract(x[side], p, 1))
    w = rf"([^{SPACE}]+)"
    rough = F.when(bare.contains("@"), "@").when(bare.rlike("[A-Za-z]"), "a").otherwise("0")
    letters = F.regexp_replace(bare, "[A-Za-z]+", "a")
    rows = rows.select(
        P + "key", "s", "e", F.xxhash64(bare).alias("inst"), rough.alias("rough"), F.regexp_replace(letters, "[0-9]+", "0").alias("close"), F.regexp_replace(letters, "[0-9]", "0").alias("exact"),
        word("l", rf"{w}[{SPACE}]+[^{SPACE}]+[{SPACE}]*$").alias("l2"), word("l", rf"{w}[{SPACE}]*$").alias("l1"),
        word("r", rf"^[{SPACE}]*{w}").alias("r1"), word("r", rf"^[{SPACE}]*[^{SPACE}]+[{SPACE}]+{w}").alias("r2"),
    )
    pattern = lambda shape, side: F.xxhash64(F.lit(f"{shape} {side}"), F.concat_ws(" ", *SIDES[side]), shape)
    made = F.array_distinct(F.array(*[pattern(shape, side) for shape, sides in PATTERNS.items() for side in sides]))
    rows = rows.select(P + "key", "s", "e", "inst", made.alias("pats"))
    # Which of them overlap a base span: joined by stretches of text, so that long lists cost no more than their length.
    stretch = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / STRETCH), F.floor((F.col(e) - 1) / STRETCH))).alias("at")
    base = scanned.select(P + "key", F.explode("base").alias("b")).select(P + "key", F.col("b.k").alias("k"), F.col("b.s").alias("bs"), F.col("b.e").alias("be")).distinct()
    base = base.select(P + "key", "k", "bs", "be", stretch("bs", "be"))
    words = rows.select(P + "key", "s", "e").distinct().select(P + "key", "s", "e", stretch("s", "e"))
    hits = words.join(base, [P + "key", "at"]).filter("bs < e and be > s").groupBy(P + "key", "s", "e").agg(F.min("k").alias("kind"))
    return save(rows.join(hits, [P + "key", "s", "e"], "left"), "pii-seen")


def _seeds(seen: DataFrame) -> DataFrame:
    """Instances that lie in base entities: inst, kind, and the share of their places that do (conf)."""
    counts = seen.groupBy("inst", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("kind").isNotNull(), F.struct("n", (-F.col("kind")).alias("k"))))
    shares = counts.groupBy("inst").agg(F.sum("n").alias("all"), best.alias("b")).filter("b is not null")
    return shares.select("inst", (-F.col("b.k")).alias("kind"), (F.col("b.n") / F.col("all")).alias("conf"))


def _scores(seen: DataFrame, rounds: int) -> DataFrame:
    """Strong patterns: pat, kind, conf."""
    edges = save(seen.select("inst", F.explode("pats").alias("pat")).distinct(), "pii-edges")
    degree = save(edges.groupBy("pat").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_SEEDS), "pii-degrees")
    seeds = save(_seeds(seen), "pii-seeds")
    known, before = seeds, -1
    while True:
        sums = [F.sum(F.when(F.col("kind") == i, F.col("conf")).otherwise(0.0)).alias(f"k{i}") for i in range(len(KINDS))]
        best = F.greatest(*[F.struct(F.col(f"k{i}").alias("c"), F.lit(i).alias("kind")) for i in range(len(KINDS))])
        scored = edges.join(broadcast_if_small(known, BROADCAST_ROWS), "inst").groupBy("pat").agg(*sums).select("pat", best.alias("b")).filter(F.col("b.c") >= MIN_SEEDS)
        conf = F.col("b.c") / (F.col("n") + 1)
        strong = save(scored.join(degree, "pat").filter(conf >= TAU).select("pat", F.col("b.kind").alias("kind"), conf.alias("conf")), "pii-patterns")
        now, rounds = strong.count(), rounds - 1
        if now <= before or rounds <= 0:
            return strong
        before = now
        found = edges.join(broadcast_if_small(strong, BROADCAST_ROWS), "pat").groupBy("inst").agg(F.max(F.struct("conf", "kind")).alias("b")).select("inst", F.col("b.kind").alias("kind"), F.col("b.conf").alias("conf"))
        both = seeds.unionByName(found).groupBy("inst").agg(F.max(F.struct("conf", "kind")).alias("b"))
        known = save(both.select("inst", F.col("b.kind").alias("kind"), F.col("b.conf").alias("conf")), "pii-known")


def _discovered(seen: DataFrame, strong: DataFrame) -> DataFrame:
    """Places outside base entities that strong patterns claim: key, s, e, found (kind)."""
    place = seen.filter("kind is null").select(P + "key", "s", "e", F.explode("pats").alias("pat")).join(broadcast_if_small(strong, BROADCAST_ROWS), "pat")
    return place.groupBy(P + "key", "s", "e").agg(F.max(F.struct("conf", "kind")).alias("b")).select(P + "key", "s", "e", F.col("b.kind").alias("found"))


def hidden_recall(docs: DataFrame, rounds: int = ROUNDS, part: int = 5) -> DataFrame:
    """What patterns find of seeds that they were not shown.

    One seed in ``part`` (by hash) is kept from the graph; the patterns of the others are then tried on it.  Per kind: places of hidden instances, how many of them are found,
    how many as that kind, and (for the kind found) places found that no base entity covers.
    """
    seen = _occurrences(save(scan(docs), "pii-scan"))
    hide = F.pmod(F.col("inst"), F.lit(part)) == 0
    masked = save(seen.withColumn("was", F.when(hide, F.col("kind"))).withColumn("kind", F.when(~hide, F.col("kind"))), "pii-masked")
    found = _discovered(masked, _scores(masked.filter("was is null"), rounds))
    rows = masked.filter("kind is null").select(P + "key", "s", "e", "was").distinct().join(found, [P + "key", "s", "e"], "left")
    name = F.array(*[F.lit(k) for k in KINDS])
    rows = rows.withColumn("k", F.coalesce("was", "found")).filter("k is not null")
    count = lambda c: F.count(F.when(c, 1))
    counted = rows.groupBy("k").agg(count(F.col("was").isNotNull()).alias("hidden"), count(F.expr("was is not null and found is not null")).alias("found"), count(F.col("was") == F.col("found")).alias("right"), count(F.col("was").isNull()).alias("beyond_base"))
    return counted.select(F.element_at(name, F.col("k") + 1).alias("kind"), "hidden", "found", "right", "beyond_base")


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, key, ``base`` and ``added`` spans (arrays of kind number, start, end)."""
    scanned = save(scan(docs), "pii-scan")
    seen = _occurrences(scanned)
    strong = _scores(seen, rounds)
    added = _discovered(seen, strong).groupBy(P + "key").agg(F.sort_array(F.collect_list(F.struct(F.col("found").alias("k"), "s", "e"))).alias("added"))
    added = broadcast_if_small(save(added, "pii-added"), BROADCAST_ROWS)
    empty = F.array().cast("array<struct<k:int,s:int,e:int>>")
    return scanned.drop("words").join(added, P + "key", "left").withColumn("added", F.coalesce("added", empty))


def _spans(a: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(a), lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    count = lambda i, k: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long").alias(f"n_{k}")
    return find(docs).select("doc_id", *[count(i, k) for i, k in enumerate(KINDS)], F.sha2(_spans(F.col("base")), 256).alias("base_sha256"), _spans(F.array_distinct(F.concat("base", "added"))).alias("spans"))


def _redacted_piece() -> Column:
    """A piece ``t`` that starts at code point ``c`` * PIECE, with its spans ``x`` (sorted) replaced; at most PIECE of either."""
    first = F.col("c") * PIECE
    part = lambda a, b: F.substring(F.col("t"), a - first + 1, b - a)

    def step(acc, x):
        start, end = F.greatest(x["s"], first), F.least(x["e"], first + F.length("t"))
        gap = F.when(start > acc["at"], part(acc["at"], start)).otherwise("")
        tag = F.when(x["fresh"] & (x["s"] >= first), F.element_at(F.array(*[F.lit(f"<{k}>") for k in KINDS]), x["k"] + 1)).otherwise("")
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.concat(acc["out"], gap, tag).alias("out"))

    begin = F.struct(first.alias("at"), F.lit("").alias("out"))
    return F.when(F.col("x").isNull(), F.col("t")).otherwise(F.aggregate("x", begin, step, lambda acc: F.concat(acc["out"], part(acc["at"], first + F.length("t")))))


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; null texts stay null.

    Texts with spans are cut into pieces, which meet the spans that touch them, so time grows with a text's length
    and not with its square, however many spans it has.
    """
    key = P + "key"
    spans = find(docs, rounds).select(key, F.explode(F.concat("base", "added")).alias("x")).select(key, "x.s", "x.e", "x.k").distinct()
    so_far = Window.partitionBy(key).orderBy("s", "e", "k").rowsBetween(Window.unboundedPreceding, -1)
    spans = save(spans.withColumn("fresh", F.col("s") >= F.coalesce(F.max("e").over(so_far), F.lit(0))), "pii-spans")
    rows = docs.withColumn(key, row_key(docs["doc_id"], docs["text"]))
    marked = broadcast_if_small(spans.select(F.col(key).alias(P + "hit")).distinct(), BROADCAST_ROWS)
    texts = rows.join(marked, F.col(key) == F.col(P + "hit"), "left_semi").select(key, "text").dropDuplicates([key])
    pieces = texts.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("c", "t"))
    touched = spans.withColumn("c", F.explode(F.sequence(F.floor(F.col("s") / PIECE).cast("int"), F.floor((F.col("e") - 1) / PIECE).cast("int"))))
    touched = touched.groupBy(key, "c").agg(F.sort_array(F.collect_list(F.struct("s", "e", "k", "fresh"))).alias("x"))
    done = pieces.join(touched, [key, "c"], "left").select(key, "c", _redacted_piece().alias("t"))
    clean = done.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "t"))), lambda x: x["t"]), "").alias(P + "clean"))
    clean = save(clean.withColumnRenamed(key, P + "hit"), "pii-clean")
    joined = rows.join(broadcast_if_small(clean, BROADCAST_ROWS), F.col(key) == F.col(P + "hit"), "left")
    return joined.select(*[F.coalesce(F.col(P + "clean"), docs["text"]).alias(c) if c == "text" else docs[c] for c in docs.columns])
