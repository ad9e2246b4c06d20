import copy
import json

import pytest

from lumenweave.plans import network
from lumenweave.plans.config import DEFAULT
from lumenweave.sources import publish


@pytest.fixture(scope="module")
def plan(spark):
    v = [(1, i * 2, s, 0.001 * (i % 4 + s), 0.001 * (i // 4)) for i in range(16) for s in (0, 1)] + [(1, 100 + i, s, 0.001 * (i % 5), 0.001 * (i // 5 + s)) for i in range(15) for s in (0, 1)]
    streets = spark.createDataFrame(v, "project_id long, way_id long, seq int, lon double, lat double")
    hps = spark.createDataFrame([(1, i, 0.0001 + 0.0039 * (i % 17) / 17, 0.0001 + 0.0028 * (i // 17) / 12) for i in range(200)] + [(2, 1, 5.0, 5.0)], "project_id long, hp_id long, lon double, lat double")
    c = copy.deepcopy(DEFAULT)
    c["engenharia"]["distancia_maxima_snap_metros"] = 80
    c["equipamentos"]["olt"] = {"latitude": 0.0, "longitude": 0.0}
    c["opcoes_visuais_e_nomes"]["nomear_cto_ceo_automaticamente"] = True
    return network.plan(hps, streets, c)


def test_boxes(plan):
    ctos = plan.ctos.filter("project_id = 1").toPandas()
    assert len(ctos) == 13 and ctos.n_hp.sum() == 200 and sorted(ctos.cto_no) == list(range(1, 14))
    assert ctos.approved.all() and (ctos.fibre_m > 0).all() and ctos.nome.str.match(r"\d{3}_N70_SP\d_SS\d").all()
    assert ctos.groupby("pon_no").ss.max().tolist() == ctos.groupby("pon_no").size().tolist()


def test_project_without_streets_fails_openly(plan):
    two = plan.ctos.filter("project_id = 2").first()
    assert not two.approved and two.fibre_m == 0 and "Sem via física" in two.verdict
    bad = plan.exceptions.filter("project_id = 2").toPandas()
    assert set(bad.status) == {"SEM_MALHA"} and set(bad.scope) == {"distribuicao", "backbone"}


def test_report_and_layers(plan, tmp_path, spark):
    r = {x.project_id: json.loads(x.report) for x in network.report(plan).collect()}
    assert len(r[1]["ctos"]) == 13 and r[1]["roteamento"]["status"] == "OK" and r[2]["roteamento"]["status"] == "COM_EXCECOES"
    assert set(r[1]["ctos"][0]) == {"id", "nome", "pon_id", "pon_numero", "ceo_id", "hp_atribuidos", "hp_indices", "coords_brutas", "coords_finais", "orcamento_optico"}
    assert sum(len(p["cto_ids"]) for p in r[1]["pons"]) == 13
    assert r[1]["olt"]["coords_configuradas"] == [0.0, 0.0] and r[1]["roteamento"]["nos_malha_viaria"] == 20 and not r[1]["roteamento"]["modo_hibrido_postes"]
    assert r[1]["validacao"]["hp_total"] == 200 and r[1]["validacao"]["pons_total"] == 2 and r[1]["validacao"]["ctos_acima_capacidade"] == 0
    assert r[1]["roteamento"]["bbox_consultado"][0] < 0 and r[2]["roteamento"]["nos_malha_viaria"] == 0
    publish.publish(plan, str(tmp_path / "out"))
    names = {p.parent.name + "/" + p.name for p in (tmp_path / "out/layers").glob("*/layer=*")}
    assert "project_id=2/layer=excecoes" in names and "project_id=1/layer=excecoes" not in names and {"project_id=1/layer=backbone", "project_id=1/layer=olt"} <= names


def test_a_plan_writes_no_table_that_only_the_report_reads_again(plan, spark, monkeypatch):
    labels, written = {}, network.written
    monkeypatch.setattr(network, "written", lambda df, label: labels.update({label: written(df, label)}) or labels[label])
    again = network.plan(plan.hps.select("project_id", "hp_id", "lon", "lat"), None, plan.config)
    assert "ctos-final" not in labels and "path" not in labels["raw-ways"].columns
    assert network.report(again).count() == 2 and "ctos-final" in labels


def test_manual_centres_and_poles(spark):
    hps = spark.createDataFrame([(1, i, 0.0001 * i, 0.0) for i in range(20)], "project_id long, hp_id long, lon double, lat double")
    centres = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.001, 0.0), (1, 3, 0.5, 0.0)], "project_id long, centre_id long, lon double, lat double")
    poles = spark.createDataFrame([(1, i, 0.0004 * i, 0.00001) for i in range(8)], "project_id long, pole_id long, lon double, lat double")
    p = network.plan(hps, None, DEFAULT, poles, centres)
    assert sorted(r.n_hp for r in p.ctos.collect()) == [0, 4, 16] or sum(r.n_hp for r in p.ctos.collect()) == 20
    kinds = {r.link for r in p.cables.collect()}
    assert kinds == {"Cascata"}  # the splice box, a mean of the centres, lies far from all poles
    assert {r.status for r in p.exceptions.collect()} == {"FORA_DA_MALHA"}
