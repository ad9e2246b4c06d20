"""SentencePiece encoding and decoding by batched Viterbi.

Texts are cut at spaces and line breaks; the distinct words of a chunk are grouped by length, and all words of one
length advance together, one character at a time.  At each end position the hashes of the last 1 to
``max_len`` characters probe the sorted hashes of the pieces.  A piece may end a prefix only if it is
compatible with the piece that ends the shorter prefix, that is, if merging the two pieces' characters
by the model's own priorities yields exactly these two pieces again.  An encoding is the one the merge
procedure gives if and only if all neighbours are compatible, so the maximum over admissible scores
leaves one candidate; its length is the backpointer.  The identifiers equal those of the library that
the model file belongs to.

Characters without a piece fall back to bytes.  Runs of spaces, whose pieces share one lowest score,
are merged last, as the model does.  Decoding maps pieces back to bytes and drops the space that
encoding put in front.  It restores every text without U+2581, which the model takes for a space.

The model's pieces and scores travel with the task (about 1 MB); workers read no file.  Every worker
keeps a bounded cache of encoded words.

Defined cases: a null text gives null identifiers and a null decoded text; an empty text gives no
identifiers; repeated rows are encoded alike; an empty table gives an empty table; columns other than
doc_id and text are never read by ``encode``.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .batches import chunks, column

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
CACHE_WORDS = 300_000
_B = np.uint64(0x100000001B3)
UNKNOWN = -2


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(message: bytes):
    """Number and value of each field of a serialised message: whole numbers, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = number() if size is None else size
        yield tag >> 3, message[at : at + size]
        at += size


# Numbers of fields and of the merge type in the public model format.
TRAINER, NORMALIZER, MODEL_TYPE, MERGES = 2, 3, 3, 2
RULES, DUMMY_PREFIX, DROP_SPACES = 2, 3, 4


def check_model(message: bytes) -> None:
    """Raises ``ValueError`` unless a serialised model is of the merge type and leaves texts as they are, but for a space in front."""
    top = dict(x for x in _fields(message) if x[0] in (TRAINER, NORMALIZER))
    if dict(_fields(top.get(TRAINER, b""))).get(MODEL_TYPE, 1) != MERGES:
        raise ValueError("a model is supported if it is of the merge (BPE) type")
    rules = dict(_fields(top.get(NORMALIZER, b"")))
    if rules.get(RULES) or rules.get(DROP_SPACES, 1) or not rules.get(DUMMY_PREFIX, 1):
        raise ValueError("a model is supported if it does not change texts, keeps all spaces and puts one in front")


@functools.lru_cache(maxsize=4)
def load(path: str) -> tuple:
    """Pieces, scores and kinds (n normal, b byte, x other) of a model file that ``check_model`` accepts."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    check_model(sp.serialized_model_proto())
    ids = range(sp.get_piece_size())
    kinds = "".join("b" if sp.is_byte(i) else "x" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "n" for i in ids)
    return tuple(sp.id_to_piece(i) for i in ids), tuple(sp.get_score(i) for i in ids), kinds


class Segmenter:
    """Encoder and decoder over one model's pieces."""

    def __init__(self, pieces, scores, kinds):
        self.pieces, self.scores = pieces, scores
        normal = [i for i, k in enumerate(kinds) if k == "n"]
        self.id_of = {pieces[i]: i for i in normal}
        chars = {c for i in normal for c in pieces[i]}
        wrong = [p for p in self.id_of if SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE))]
        if wrong or not chars <= self.id_of.keys():
            raise ValueError("a model is supported if spaces only begin its pieces and every character of a piece is a piece")
        if "\n" in chars:
            raise ValueError("a model is supported if it has no piece with a line break")
        levels = {x: i for i, x in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        self.rank = {p: levels[scores[i]] for p, i in self.id_of.items()}
        self.byte_id = {int(pieces[i][1:-1], 16): i for i, k in enumerate(kinds) if k == "b"}
        self.space_id = self.id_of[SPACE]
        words = [i for i in normal if not pieces[i].startswith(SPACE * 2)]
        self.max_len = max(len(pieces[i]) for i in words)
        self.codes = np.zeros((len(pieces), self.max_len), np.uint32)
        for i in words:
            self.codes[i, : len(pieces[i])] = [ord(c) for c in pieces[i]]
        self.pow = np.array([pow(int(_B), k, 2**64) for k in range(self.max_len + 1)], np.uint64)
        h = np.array([self._hash(pieces[i]) for i in words], np.uint64)
        order = np.argsort(h)
        self.keys, self.key_ids = h[order], np.array(words, np.int64)[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.alone = np.zeros(len(pieces), bool)
        for i in words:
            self.alone[i] = self._merge(pieces[i]) == [i]
        self.pair_keys, self.pair_ok = np.zeros(1 << 22, np.uint64), np.zeros(1 << 22, bool)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.runs: dict[int, list[int]] = {}
        raw = [bytes([int(p[1:-1], 16)]) if k == "b" else b"" if k == "x" else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _mixed(self, h, k):
        return (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_B) + ord(c) + 1) % 2**64
        return ((h + len(piece)) * 0x9E3779B97F4A7C15) % 2**64

    def _merge(self, text: str) -> list[int]:
        """Identifiers of ``text`` by merging the best adjacent pair, leftmost first, until none is a piece."""
        part, get, none = list(text), self.rank.get, len(self.rank)
        best = [get(x + y, none) for x, y in zip(part, part[1:], strict=False)]
        while best and (low := min(best)) < none:
            i = best.index(low)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del best[i]
            if i < len(best):
                best[i] = get(part[i] + part[i + 1], none)
            if i:
                best[i - 1] = get(part[i - 1] + part[i], none)
        return [self.id_of.get(p, UNKNOWN) for p in part]

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbouring pieces stands under the merge procedure."""
        out = self.alone[b]
        real = np.nonzero((a >= 0) & out)[0]
        key = (a[real].astype(np.uint64) << np.uint64(32)) | (b[real].astype(np.uint64) + np.uint64(1))
        slot = ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(42)).astype(np.int64)
        hit = self.pair_keys[slot] == key
        ok = self.pair_ok[slot]
        if not hit.all():
            missing, back = np.unique(key[~hit], return_inverse=True)
            fresh = np.empty(len(missing), bool)
            for n, k in enumerate(missing.tolist()):
                x, y = k >> 32, (k & 0xFFFFFFFF) - 1
                fresh[n] = self._merge(self.pieces[x] + self.pieces[y]) == [x, y]
            at = ((missing * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(42)).astype(np.int64)
            self.pair_keys[at], self.pair_ok[at] = missing, fresh
            self.pair_keys[at] = missing  # of pairs that share a slot, the last stays
            last = self.pair_keys[at] == missing
            self.pair_ok[at[last]] = fresh[last]
            ok[~hit] = fresh[back]
        out[real] = ok
        return out

    def _same_length(self, words: list[str], size: int) -> list[bytes]:
        n = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size)
        pre = np.zeros((size + 1, n), np.uint64)
        for e in range(size):
            pre[e + 1] = pre[e] * _B + codes[:, e] + np.uint64(1)
        last = np.full((size + 1, n), -1, np.int64)
        back = np.ones((size + 1, n), np.int64)
        for e in range(1, size + 1):
            for k in range(1, min(e, self.max_len) + 1):
                h = self._mixed(pre[e] - pre[e - k] * self.pow[k], k)
                rows = np.nonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])[0]
                if not len(rows):
                    continue
                at = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
                good = self.keys[at] == h[rows]
                rows, piece = rows[good], self.key_ids[at[good]]
                exact = (self.codes[piece, :k] == codes[rows, e - k : e]).all(axis=1)
                rows, piece = rows[exact], piece[exact]
                if e > k:
                    prev = last[e - k, rows]
                    ok = (prev != -1) & self._compatible(prev, piece)
                else:
                    ok = self.alone[piece]
                rows, piece = rows[ok], piece[ok]
                better = last[e, rows] == -1
                last[e, rows[better]], back[e, rows[better]] = piece[better], k
            last[e, last[e] == -1] = UNKNOWN  # a character without a piece
        at, cols = np.full(n, size), np.arange(n)
        steps = []
        while (live := at > 0).any():
            steps.append(np.where(live, last[at, cols], -1))
            at = np.where(live, at - back[at, cols], 0)
        table = np.stack(steps[::-1], axis=1)
        kept = table != -1
        flat, counts = table[kept], kept.sum(axis=1)
        data, ends = flat.astype(np.int32).tobytes(), np.cumsum(counts) * 4
        out = [data[j - 4 * c : j] for j, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        for i in np.nonzero((table == UNKNOWN).any(axis=1))[0].tolist():
            out[i] = self._with_bytes(words[i], table[i][kept[i]].tolist())
        return out

    def _with_bytes(self, word: str, ids: list[int]) -> bytes:
        out, at = [], 0
        for i in ids:
            if i == UNKNOWN:
                out += [self.byte_id[x] for x in word[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                out.append(i)
                at += len(self.pieces[i])
        return np.array(out, np.int32).tobytes()

    def words(self, parts: list[str]) -> list[bytes]:
        """Identifiers (int32 bytes) of each distinct part: a word after a space, or after a line break if it begins with one."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        by_size: dict[int, list[str]] = {}
        for p in parts:
            if p not in cache:
                if p in older:
                    cache[p] = older[p]
                else:
                    w = p[1:] if p[:1] == "\n" else SPACE + p
                    by_size.setdefault(len(w), []).append(p)
        line = np.array([self.byte_id[10]], np.int32).tobytes() if 10 in self.byte_id else b""
        for size, group in by_size.items():
            step = max(1, 4_000_000 // (size * 24 + 1))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                if not size:
                    cache[part[0]] = line
                    continue
                ids = self._same_length([p[1:] if p[:1] == "\n" else SPACE + p for p in part], size)
                cache.update((p, line + x if p[:1] == "\n" else x) for p, x in zip(part, ids, strict=True))
        out = [cache[p] for p in parts]
        for group in by_size.values():
            if len(group[0]) > 64:
                for p in group:
                    del cache[p]
        return out

    def _run(self, n: int) -> list[int]:
        if n not in self.runs:
            self.runs[n] = self._merge(SPACE * n)
        return self.runs[n]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat identifiers of a chunk of texts (Arrow strings without nulls)."""
        plain = pc.replace_substring(texts.cast(pa.large_string()), SPACE, " ")
        parts = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        enc = self.words(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(enc), np.int32)
        size = np.array([len(x) // 4 for x in enc], np.int64)
        start = np.cumsum(size) - size
        empty = (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
        count = size[index]
        offsets = offsets - offsets[0]
        if empty.any():  # an empty text splits into one empty part
            count = count.copy()
            count[offsets[:-1][empty]] = 0
        ends = np.concatenate(([0], np.cumsum(count)))
        ids = flat[np.repeat(start[index] - ends[:-1], count) + np.arange(ends[-1])]
        return self._merge_runs(ids, ends[offsets])

    def _merge_runs(self, ids: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = ids == self.space_id
        pair = space[1:] & space[:-1]
        first = doc_ends[1:-1]
        first = first[(first > 0) & (first < len(ids))]
        pair[first - 1] = False
        if not pair.any():
            return doc_ends, ids
        edge = np.diff(np.concatenate(([0], pair.view(np.int8), [0])))
        begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0] + 1
        out, shrink, at = [], np.zeros(len(ids) + 1, np.int64), 0
        for i, j in zip(begin.tolist(), end.tolist(), strict=True):
            run = self._run(j - i)
            out += [ids[at:i], np.array(run, np.int32)]
            shrink[j] = j - i - len(run)
            at = j
        out.append(ids[at:])
        return doc_ends - np.cumsum(shrink)[doc_ends], np.concatenate(out)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of flat identifiers."""
        size = self.raw_len[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        data = self.raw[np.repeat(self.raw_at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        at = ends[offsets].tolist()
        out = [data[i:j].decode("utf-8", "replace") for i, j in zip(at, at[1:], strict=False)]
        return [t[1:] if t.startswith(" ") else t for t in out]


@functools.lru_cache(maxsize=2)
def _segmenter(key: int) -> Segmenter:
    return Segmenter(*_MODELS[key])


_MODELS: dict[int, tuple] = {}


def segmenter(model: tuple) -> Segmenter:
    """One segmenter for each model and process."""
    key = hash(model)
    _MODELS[key] = model
    return _segmenter(key)


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the columns ``keep``, ``ids`` (array of int) and ``decoded``, the text that the identifiers decode to."""
    shipped = docs.sparkSession.sparkContext.broadcast(load(path or model_path()))

    def run(batches):
        seg = segmenter(shipped.value)
        for b in chunks(batches):
            text = column(b, "text")
            offsets, ids = seg.encode(pc.fill_null(text, ""))
            decoded = seg.decode(offsets, ids)
            null = text.is_null()
            mask = pa.array(null)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*[column(b, c) for c in keep], pc.if_else(mask, pa.nulls(len(lists), lists.type), lists), pc.if_else(mask, pa.nulls(len(decoded), pa.string()), pa.array(decoded, pa.string()))],
                [*keep, "ids", "decoded"],
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kinds}, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) as doc_id and text; null identifiers give a null text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(load(path or model_path()))

    def run(batches):
        seg = segmenter(shipped.value)
        for b in batches:
            lists = column(b, "ids")
            full = pc.fill_null(lists, [])
            offsets = full.offsets.to_numpy().astype(np.int64)
            texts = seg.decode(offsets - offsets[0], full.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pc.if_else(lists.is_null(), pa.nulls(len(texts), pa.string()), pa.array(texts, pa.string()))], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
