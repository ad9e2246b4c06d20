import copy
import json

import pytest

from lumenweave.plans import config as conf


def changed(path, value):
    c = copy.deepcopy(conf.DEFAULT)
    at = c
    *parts, last = path.split(".")
    for p in parts:
        at = at[p]
    if value is KeyError:
        del at[last]
    else:
        at[last] = value
    return c


def test_default_is_valid_and_loads(tmp_path):
    assert len(conf.RULES) == 40
    f = tmp_path / "config.json"
    f.write_text(json.dumps(conf.DEFAULT))
    assert conf.load(f) == conf.DEFAULT


@pytest.mark.parametrize(
    ("path", "value"),
    [
        ("api.overpass_retry_max", KeyError), ("engenharia.ctos_por_pon", True), ("engenharia.distancia_maxima_entre_ctos_metros", 0), ("api.overpass_backoff_factor", -0.1),
        ("engenharia.reserva_capacidade_percentual", 1.01), ("engenharia.splitter_cto_inicial", 17), ("engenharia.splitter_cto_expansao", 12), ("equipamentos.olt.latitude", -2.5),
        ("engenharia.margem_bbox_roteamento_metros", -1), ("versao", "  "), ("engenharia.topologia_backbone.modo", "estrela"), ("engenharia.penetracao_estimada", 0),
        ("orcamento_optico.sensibilidade_minima_onu_dbm", 0), ("engenharia.capacidade_hp_por_cto", 1.5), ("engenharia.fisica", {"margem_flecha_percentual": 0.03}),
    ],
)
def test_rejects(path, value):
    with pytest.raises(conf.ConfigError):
        conf.checked(changed(path, value))


def test_defaults_fill_whole_blocks():
    c = copy.deepcopy(conf.DEFAULT)
    del c["engenharia"]["fisica"], c["engenharia"]["topologia_backbone"], c["entrada"]["arquivo_postes"]
    c["orcamento_optico"] = {}
    got = conf.checked(c)
    assert got["engenharia"]["fisica"] == conf.PHYSICAL
    assert got["engenharia"]["topologia_backbone"] == {"modo": "arvore", "permitir_rotas_parcialmente_disjuntas": False}
    assert got["orcamento_optico"] == conf.OPTICAL


def test_files(tmp_path):
    with pytest.raises(FileNotFoundError):
        conf.load(tmp_path / "none.json")
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(conf.ConfigError):
        conf.load(tmp_path / "bad.json")


def test_logging(tmp_path):
    from lumenweave import logs

    log = logs.configure(tmp_path / "a" / "b", "lumenweave.test")
    assert logs.configure(tmp_path, "lumenweave.test") is log and len(log.handlers) == 2
    log.debug("detail")
    assert "detail" in (tmp_path / "a" / "b" / "lumenweave.test.log").read_text()
