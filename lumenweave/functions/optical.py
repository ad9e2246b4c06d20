"""Optical loss budget as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo


def budget(feeder_m: Column, distribution_m: Column, splices: int, config: dict) -> Column:
    """struct attenuation_db, signal_dbm, approved; approval looks at the loss before rounding.

    Both splitter losses are always summed, as are two connectors.  Losses add up in the order of the SQL and round
    in binary (``geo.rounded``): another order or decimal rounding gives another last digit on some ties.
    """
    o = config["orcamento_optico"]
    p = {k: float(v) for k, v in o["perdas"].items()}
    tx, rx, margin = (float(o[k]) for k in ("potencia_saida_olt_dbm", "sensibilidade_minima_onu_dbm", "margem_seguranca_db"))
    fibre = (feeder_m + distribution_m) / F.lit(1000.0) * F.lit(p["fibra_por_km"])
    loss = fibre + F.lit(splices * p["fusao"]) + F.lit(2 * p["conector"]) + F.lit(p["splitter_1x8"] + p["splitter_1x16"])
    return F.struct(geo.rounded(loss, 2).alias("attenuation_db"), geo.rounded(F.lit(tx) - loss, 2).alias("signal_dbm"), (loss <= F.lit((tx - rx) - margin)).alias("approved"))


def verdict(b: Column) -> Column:
    """The verdict's text."""
    signal, loss = b["signal_dbm"].cast("string"), b["attenuation_db"].cast("string")
    good = F.concat(F.lit("APROVADO (Sinal Estimado: "), signal, F.lit(" dBm | Atenuação: "), loss, F.lit(" dB)"))
    return F.when(b["approved"], good).otherwise(F.concat(F.lit("REPROVADO (Sinal Estimado: "), signal, F.lit(" dBm - Abaixo da sensibilidade)")))
