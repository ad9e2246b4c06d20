"""Which input file is the project, its corrections, its poles."""

from __future__ import annotations

from pathlib import Path

# Suffixes that are read, and parts of names that mark corrections and poles.
SUFFIXES = (".kml", ".kmz")
CORRECTION_MARKS, POLE_MARK = ("editad", "corrig", "poste"), "poste"


def is_correction(path: str | Path) -> bool:
    return any(m in Path(path).stem.lower() for m in CORRECTION_MARKS)


def listed(folder: str | Path) -> list[Path]:
    """KML and KMZ files in order of their lower-case names."""
    return sorted((p for p in Path(folder).iterdir() if p.is_file() and p.suffix.lower() in SUFFIXES), key=lambda p: p.name.lower())


def _chosen(folder, named: str | None, what: str, key: str, candidates: list[Path], required: bool) -> Path | None:
    if named:
        path = Path(folder) / named
        if not path.exists():
            raise FileNotFoundError(f"Arquivo de {what} configurado não encontrado: '{path}'.")
        if path.suffix.lower() not in SUFFIXES:
            raise ValueError(f"Arquivo de {what} deve ser KML ou KMZ: '{path.name}'.")
        return path
    if len(candidates) > 1:
        raise ValueError(f"Mais de um arquivo de {what}: {', '.join(p.name for p in candidates)}. Defina 'entrada.{key}'.")
    if not candidates and required:
        raise FileNotFoundError(f"Nenhum arquivo KML/KMZ de {what} foi encontrado.")
    return candidates[0] if candidates else None


def project_file(folder, config: dict) -> Path:
    """The named file, else the only one that is no correction."""
    named = config.get("entrada", {}).get("arquivo_projeto")
    return _chosen(folder, named, "projeto", "arquivo_projeto", [] if named else [p for p in listed(folder) if not is_correction(p)], True)


def correction_file(folder, config: dict) -> Path | None:
    named = config.get("entrada", {}).get("arquivo_correcoes")
    return _chosen(folder, named, "correções", "arquivo_correcoes", [] if named else [p for p in listed(folder) if is_correction(p) and POLE_MARK not in p.name.lower()], False)


def pole_file(folder, config: dict) -> Path | None:
    named = config.get("entrada", {}).get("arquivo_postes")
    return _chosen(folder, named, "postes", "arquivo_postes", [] if named else [p for p in listed(folder) if POLE_MARK in p.name.lower()], False)


def box_names(points):
    """Points whose names mark terminal boxes (CTO or SS), from a frame with ``nome``."""
    from pyspark.sql import functions as F

    name = F.upper("nome")
    return points.filter(name.contains("CTO") | name.contains("SS"))
