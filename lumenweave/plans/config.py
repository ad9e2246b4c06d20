"""Configuration: defaults, injected blocks, rules as data, loading and checking."""

from __future__ import annotations

import copy
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Blocks that older files lack.
PHYSICAL = {"margem_flecha_percentual": 0.03, "reserva_tecnica_cto_metros": 10.0, "reserva_tecnica_ceo_metros": 30.0, "reserva_tecnica_olt_metros": 50.0}
LEGACY_BACKBONE = {"modo": "arvore", "permitir_rotas_parcialmente_disjuntas": False}
OPTICAL = {
    "potencia_saida_olt_dbm": 4.5, "sensibilidade_minima_onu_dbm": -27.0, "margem_seguranca_db": 2.0,
    "perdas": {"fibra_por_km": 0.25, "fusao": 0.1, "conector": 0.5, "splitter_1x8": 10.5, "splitter_1x16": 13.5},
}
DEFAULT = {
    "versao": "9.0",
    "entrada": {"arquivo_projeto": None, "arquivo_correcoes": None, "arquivo_postes": None},
    "engenharia": {
        "penetracao_estimada": 0.5, "reserva_capacidade_percentual": 0.0, "capacidade_hp_por_cto": 16, "splitter_cto_inicial": 8, "splitter_cto_expansao": 16,
        "ctos_por_pon": 8, "pons_por_ceo": 2, "distancia_maxima_snap_metros": 50, "distancia_maxima_entre_ctos_metros": 150, "margem_bbox_roteamento_metros": 150,
        "fisica": PHYSICAL, "topologia_backbone": {"modo": "anel", "permitir_rotas_parcialmente_disjuntas": True},
    },
    "equipamentos": {"nome_olt_padrao": "N70", "olt": {"latitude": None, "longitude": None}},
    "orcamento_optico": OPTICAL,
    "opcoes_visuais_e_nomes": {"nomear_cto_ceo_automaticamente": False, "colorir_cto_por_pon": True, "colorir_cabos_por_pon": True},
    "api": {"overpass_timeout_segundos": 60, "overture_timeout_segundos": 60, "overpass_retry_max": 5, "overpass_backoff_factor": 1.0},
    "cache": {"versao": "2.0", "expirar_dias": 30},
}

#: Rules: path, kind (s string, i whole, n number, b boolean; ? may be null), lower bound, upper bound, strict
#: bounds (l, u or both).  A string must not be blank; bounds are null where open.
RULES: list[tuple] = [
    ("versao", "s", None, None, ""),
    ("entrada.arquivo_projeto", "s?", None, None, ""),
    ("entrada.arquivo_correcoes", "s?", None, None, ""),
    ("entrada.arquivo_postes", "s?", None, None, ""),
    ("engenharia.penetracao_estimada", "n", 0.0, 1.0, "l"),
    ("engenharia.reserva_capacidade_percentual", "n", 0.0, 1.0, ""),
    *[(f"engenharia.{k}", "i", 0.0, None, "l") for k in ("capacidade_hp_por_cto", "splitter_cto_inicial", "splitter_cto_expansao", "ctos_por_pon", "pons_por_ceo")],
    ("engenharia.distancia_maxima_snap_metros", "n", 0.0, None, ""),
    ("engenharia.distancia_maxima_entre_ctos_metros", "n", 0.0, None, "l"),
    ("engenharia.margem_bbox_roteamento_metros", "n", 0.0, None, ""),
    *[(f"engenharia.fisica.{k}", "n", 0.0, None, "") for k in PHYSICAL],
    ("engenharia.topologia_backbone.modo", "s", None, None, "arvore|anel"),
    ("engenharia.topologia_backbone.permitir_rotas_parcialmente_disjuntas", "b", None, None, ""),
    ("equipamentos.nome_olt_padrao", "s", None, None, ""),
    ("equipamentos.olt.latitude", "n?", -90.0, 90.0, ""),
    ("equipamentos.olt.longitude", "n?", -180.0, 180.0, ""),
    *[(f"opcoes_visuais_e_nomes.{k}", "b", None, None, "") for k in ("nomear_cto_ceo_automaticamente", "colorir_cto_por_pon", "colorir_cabos_por_pon")],
    ("api.overpass_timeout_segundos", "i", 0.0, None, "l"),
    ("api.overture_timeout_segundos", "i", 0.0, None, "l"),
    ("api.overpass_retry_max", "i", 0.0, None, ""),
    ("api.overpass_backoff_factor", "n", 0.0, None, ""),
    ("cache.versao", "s", None, None, ""),
    ("cache.expirar_dias", "i", 0.0, None, "l"),
    ("orcamento_optico.potencia_saida_olt_dbm", "n", None, None, ""),
    ("orcamento_optico.sensibilidade_minima_onu_dbm", "n", None, 0.0, "u"),
    ("orcamento_optico.margem_seguranca_db", "n", 0.0, None, ""),
    *[(f"orcamento_optico.perdas.{k}", "n", 0.0, None, "") for k in ("fibra_por_km", "fusao", "conector", "splitter_1x8", "splitter_1x16")],
]
CROSS = (
    "engenharia.splitter_cto_inicial não pode superar splitter_cto_expansao",
    "engenharia.splitter_cto_expansao deve comportar todos os HP da CTO",
    "equipamentos.olt.latitude e longitude devem ser informadas juntas ou ambas nulas",
)


class ConfigError(ValueError):
    """A configuration that a rule rejects."""


def with_defaults(config: dict) -> dict:
    """A copy with the blocks that older files lack; a block that is there but incomplete stays as it is."""
    c = copy.deepcopy(config)
    c.setdefault("entrada", {}).setdefault("arquivo_postes", None)
    e = c.setdefault("engenharia", {})
    e.setdefault("fisica", copy.deepcopy(PHYSICAL))
    e.setdefault("topologia_backbone", copy.deepcopy(LEGACY_BACKBONE))
    if not c.get("orcamento_optico"):
        c["orcamento_optico"] = copy.deepcopy(OPTICAL)
    return c


def _kind(v) -> str:
    return "b" if isinstance(v, bool) else "i" if isinstance(v, int) else "n" if isinstance(v, float) else "s" if isinstance(v, str) else "null" if v is None else "other"


def violations(config: dict) -> list[str]:
    """All violated rules in order, cross-field rules last; empty for a valid configuration."""
    out, at = [], {}
    for path, kind, low, high, extra in RULES:
        v = config
        for part in path.split("."):
            v = v[part] if isinstance(v, dict) and part in v else KeyError
            if v is KeyError:
                break
        if v is KeyError:
            out.append(f"Campo obrigatório ausente: {path}")
            continue
        at[path], k = v, _kind(v)
        if k == "null" and kind.endswith("?"):
            continue
        if not (k == kind[0] or (kind[0] == "n" and k == "i")):
            out.append(f"{path}: esperado {kind}, recebido {type(v).__name__}")
        elif (k == "s" and (not v.strip() or (extra and v not in extra.split("|")))) or (
            k in "in" and ((low is not None and (v < low or ("l" in extra and v == low))) or (high is not None and (v > high or ("u" in extra and v == high))))
        ):
            out.append(f"{path}: valor inválido ({v})")
    if not out:
        first, most, cap = (at[f"engenharia.{k}"] for k in ("splitter_cto_inicial", "splitter_cto_expansao", "capacidade_hp_por_cto"))
        bad = (first > most, most < cap, (at["equipamentos.olt.latitude"] is None) != (at["equipamentos.olt.longitude"] is None))
        out += [text for text, wrong in zip(CROSS, bad, strict=True) if wrong]
    return out


def checked(config: dict) -> dict:
    """The configuration with defaults; raises for the first violated rule."""
    c = with_defaults(config)
    for text in violations(c):
        raise ConfigError(text)
    return c


def load(path: str | Path) -> dict:
    """Reads and checks a configuration file."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"Config não encontrada: {path}")
    try:
        raw = json.loads(path.read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ConfigError(f"JSON inválido em {path}: {e}") from e
    return checked(raw)


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as rows: path, kind, low, high, strict."""
    return spark.createDataFrame(RULES, "path string, kind string, low double, high double, strict string")


def check_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves (config_id, path, kind, num, txt) of many configurations against the rules: one row per violation."""
    rules = F.broadcast(rule_table(leaves.sparkSession).withColumnRenamed("kind", "want"))  # a fixed few rows
    ids = leaves.select("config_id").distinct()
    rows = ids.crossJoin(rules).join(leaves, ["config_id", "path"], "left")
    base = F.substring("want", 1, 1)
    typed = (F.col("kind") == base) | ((base == "n") & (F.col("kind") == "i"))
    free = (F.col("kind") == "null") & F.col("want").endswith("?")
    text = (F.col("kind") != "s") | ((F.length(F.trim("txt")) > 0) & ((F.col("strict") == "") | F.array_contains(F.split("strict", r"\|"), F.col("txt"))))
    low = F.col("low").isNull() | F.when(F.col("strict").contains("l"), F.col("num") > F.col("low")).otherwise(F.col("num") >= F.col("low"))
    high = F.col("high").isNull() | F.when(F.col("strict") == "u", F.col("num") < F.col("high")).otherwise(F.col("num") <= F.col("high"))
    number = ~F.col("kind").isin("i", "n") | (low & high)
    reason = F.when(F.col("kind").isNull(), "missing").when(free, None).when(~typed, "type").when(~(text & number), "value")
    return rows.withColumn("reason", reason).filter("reason is not null").select("config_id", "path", "reason")


def check_cross(leaves: DataFrame) -> DataFrame:
    """The cross-field rules on configurations whose leaves all pass: config_id and the violated rule's text."""
    at = lambda path, name: F.max(F.when(F.col("path") == path, F.col("num"))).alias(name)
    rows = leaves.groupBy("config_id").agg(
        at("engenharia.splitter_cto_inicial", "first"), at("engenharia.splitter_cto_expansao", "most"), at("engenharia.capacidade_hp_por_cto", "cap"),
        at("equipamentos.olt.latitude", "lat"), at("equipamentos.olt.longitude", "lon"),
    )
    rows = rows.join(check_leaves(leaves).select("config_id").distinct(), "config_id", "left_anti")
    bad = (F.col("first") > F.col("most"), F.col("most") < F.col("cap"), F.col("lat").isNull() != F.col("lon").isNull())
    texts = F.array_compact(F.array(*[F.when(wrong, F.lit(text)) for text, wrong in zip(CROSS, bad, strict=True)]))
    return rows.select("config_id", F.explode(texts).alias("rule"))
