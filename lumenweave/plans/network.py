"""The whole plan: from HPs, streets, poles and a configuration to tables of boxes, cables, verdicts and a report."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import clusters, graph, placement, spatial
from ..operators.graph import OK
from ..storage import together, written


@dataclass
class Plan:
    """The tables of a plan, each with project_id."""

    hps: DataFrame
    ctos: DataFrame
    pons: DataFrame
    ceos: DataFrame
    olts: DataFrame
    cables: DataFrame
    exceptions: DataFrame
    edges: DataFrame
    poles: DataFrame
    config: dict


def plan(hps: DataFrame, streets: DataFrame | None, config: dict, poles: DataFrame | None = None, centres: DataFrame | None = None) -> Plan:
    """Plans all projects at once.

    ``hps``: project_id, hp_id, lon, lat; ``streets``: project_id, way_id, seq, lon, lat; ``poles``: project_id,
    pole_id, lon, lat; ``centres``: manual boxes (project_id, centre_id, lon, lat).
    """
    spark, e, look = hps.sparkSession, config["engenharia"], config["opcoes_visuais_e_nomes"]
    snap_m, gap_m = float(e["distancia_maxima_snap_metros"]), float(e["distancia_maxima_entre_ctos_metros"])
    olt_name, auto = config["equipamentos"]["nome_olt_padrao"], look["nomear_cto_ceo_automaticamente"]
    if streets is None:
        streets = spark.createDataFrame([], "project_id long, way_id long, seq int, lon double, lat double")

    def mesh():
        segs = written(spatial.street_segments(streets, ["project_id"]), "segments")
        spans = None
        if poles is not None:
            spans = written(spatial.crossing_penalty(spatial.pole_spans(poles, ["project_id"]), segs, ["project_id"]), "spans")
        return segs, spans, written(graph.graph_of(graph.street_edges(streets), spans), "edges")

    members, (segs, spans, edges) = together(spark, lambda: written(clusters.hierarchy(hps, config, centres), "hierarchy"), mesh)
    boxes = members.groupBy("project_id", "cto", "pon", "ceo", "cto_lon", "cto_lat", "pon_lon", "pon_lat", "ceo_lon", "ceo_lat").agg(
        F.count("hp_id").alias("n_hp"), F.sort_array(F.collect_list("hp_id")).alias("hp_ids")
    )
    place = boxes.select("project_id", "ceo", F.col("ceo_lon").alias("lon"), F.col("ceo_lat").alias("lat")).distinct()
    ceos = spatial.snapped(place, segs, "ceo", ["project_id"], snap_m).select("project_id", "ceo", F.col("lon").alias("raw_lon"), F.col("lat").alias("raw_lat"), F.col("snap_lon").alias("lon"), F.col("snap_lat").alias("lat"))
    ceos = written(ceos, "ceos")
    order = placement.ceo_order(ceos)
    pons = boxes.select("project_id", "pon", "ceo", "pon_lon", "pon_lat", "ceo_lon", "ceo_lat").distinct()
    pons = written(placement.pon_numbers(pons, order), "pons")
    tags = placement.pon_tag(pons)
    ceo_name = placement.named(F.col("ceo_ord"), 2, olt_name, F.col("tag")) if auto else F.lit("CEO")
    ceos = ceos.join(tags, ["project_id", "ceo"]).withColumn("nome", ceo_name).withColumn("id", F.format_string("CEO_%04d", "ceo"))
    ceos = written(ceos.withColumn("referencia", F.col("nome") if auto else F.col("id")), "ceos")

    at = ceos.select("project_id", "ceo", F.col("lon").alias("ceo_x"), F.col("lat").alias("ceo_y"), F.col("referencia").alias("ceo_ref"))

    def distribution():
        raw = boxes.drop("ceo_lon", "ceo_lat", "pon_lon", "pon_lat").withColumnsRenamed({"cto_lon": "lon", "cto_lat": "lat"}).join(at, ["project_id", "ceo"])
        raw = written(raw, "boxes")
        ways = graph.routes(placement.pon_pairs(raw).withColumn("kind", F.lit("distribuicao")), edges, config, snap_m)
        ways = written(ways.select("project_id", "pon", "a", "b", (F.col("status") == OK).alias("ok"), "dist_m"), "raw-ways")  # orders need no paths
        seq = placement.cto_order(raw.select("project_id", "pon", "cto", "lon", "lat", "ceo_x", "ceo_y"), ways, gap_m)
        ctos = spatial.snapped(raw, segs, "cto", ["project_id"], snap_m).withColumnsRenamed({"lon": "raw_lon", "lat": "raw_lat", "snap_lon": "lon", "snap_lat": "lat"})
        ctos = ctos.join(seq, ["project_id", "pon", "cto"]).join(pons.select("project_id", "pon", "pon_no", "ceo_ord"), ["project_id", "pon"])
        ctos = ctos.withColumn("cto_no", F.row_number().over(Window.partitionBy("project_id").orderBy("pon_no", "ss")))
        cto_name = placement.named(F.col("cto_no"), 3, olt_name, F.format_string("SP%d_SS%d", "pon_no", "ss")) if auto else F.lit("CTO")
        ctos = ctos.withColumn("nome", cto_name).withColumn("id", F.format_string("CTO_%04d", "cto")).withColumn("hc_estimado_teorico", F.col("n_hp") * F.lit(float(e["penetracao_estimada"])))
        ctos = written(ctos.withColumn("referencia", F.col("nome") if auto else F.col("id")), "ctos")

        # Distribution: which box feeds which, from routes between the snapped places.
        ask = placement.pon_pairs(ctos).withColumn("kind", F.lit("cto"))
        found = written(graph.routes(ask, edges, config, snap_m), "ways")
        return ctos, found

    def backbone():
        # Backbone: OLT (node 0) and splice boxes in order.
        nodes = ceos.select("project_id", F.col("ceo_ord").alias("node"), "lon", "lat", "id", "referencia")
        olt = config["equipamentos"]["olt"]
        olts = spark.createDataFrame([], "project_id long, id string, nome string, raw_lon double, raw_lat double, lon double, lat double")
        if olt["latitude"] is not None:
            spot = ceos.select("project_id").distinct().select("project_id", F.lit(0).alias("node"), F.lit(float(olt["longitude"])).alias("lon"), F.lit(float(olt["latitude"])).alias("lat"))
            moved = written(spatial.snapped(spot, segs, "node", ["project_id"], snap_m), "olt")
            olts = moved.select("project_id", F.lit("OLT_0001").alias("id"), F.lit(olt_name).alias("nome"), F.col("lon").alias("raw_lon"), F.col("lat").alias("raw_lat"), F.col("snap_lon").alias("lon"), F.col("snap_lat").alias("lat"))
            nodes = nodes.unionByName(moved.select("project_id", "node", F.col("snap_lon").alias("lon"), F.col("snap_lat").alias("lat"), F.lit("OLT_0001").alias("id"), F.lit(olt_name).alias("referencia")))
        nodes = written(nodes, "backbone-nodes")
        pairs = written(placement.backbone_weight(graph.routes(placement.backbone_requests(nodes), edges, config, snap_m)), "backbone-pairs")
        return olts, nodes, pairs

    (ctos, ways), (olts, nodes, pairs) = together(spark, distribution, backbone)
    links = placement.distribution_links(ctos, ways.select("project_id", "pon", "a", "b", (F.col("status") == OK).alias("ok"), "dist_m"), gap_m)
    links = links.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    full = links.join(ways.withColumnsRenamed({"a": "lo", "b": "hi"}), ["project_id", "pon", "lo", "hi"])
    ref = ctos.select("project_id", "cto", "id", "referencia", "cto_no")
    full = full.join(ref.withColumnsRenamed({"cto": "b", "id": "b_id", "referencia": "b_ref"}), ["project_id", "b"])
    full = full.join(ref.drop("cto_no").withColumnsRenamed({"cto": "a", "id": "a_id", "referencia": "a_ref"}), ["project_id", "a"], "left")
    home = ctos.select("project_id", "pon", "ceo", "ceo_ref", "pon_no").distinct()
    full = full.join(home, ["project_id", "pon"])
    turned = F.col("a") > F.col("b")
    full = full.select(
        "project_id", F.lit("distribuicao").alias("scope"), "link", F.coalesce("a_ref", "ceo_ref").alias("a_ref"), "b_ref", F.coalesce("a_id", F.format_string("CEO_%04d", "ceo")).alias("a_id"), "b_id",
        "status", "dist_m", F.when(turned, F.reverse("path")).otherwise(F.col("path")).alias("path"), "message",
        F.when(turned, F.col("snap_d_m")).otherwise(F.col("snap_o_m")).alias("snap_o_m"), F.when(turned, F.col("snap_o_m")).otherwise(F.col("snap_d_m")).alias("snap_d_m"),
        F.when(turned, F.col("d_lon")).otherwise(F.col("o_lon")).alias("o_lon"), F.when(turned, F.col("d_lat")).otherwise(F.col("o_lat")).alias("o_lat"),
        F.when(turned, F.col("o_lon")).otherwise(F.col("d_lon")).alias("d_lon"), F.when(turned, F.col("o_lat")).otherwise(F.col("d_lat")).alias("d_lat"),
        placement.pon_colour(F.col("pon_no"), look["colorir_cabos_por_pon"]).alias("colour"), F.col("cto_no").alias("seq"),
    )

    mode = e.get("topologia_backbone", {}).get("modo", "arvore")
    legs = graph.backbone_edges(pairs, mode).join(pairs, ["project_id", "a", "b"])
    name = lambda c: nodes.select("project_id", F.col("node").alias(c), F.col("referencia").alias(c + "_ref"), F.col("id").alias(c + "_id"))
    legs = legs.join(name("a"), ["project_id", "a"]).join(name("b"), ["project_id", "b"])
    kind = F.lit("Feeder_Anel") if mode == "anel" else F.when(F.col("a") == 0, "Feeder_OLT").otherwise("Backbone")
    legs = legs.select(
        "project_id", F.lit("backbone").alias("scope"), kind.alias("link"), "a_ref", "b_ref", "a_id", "b_id", "status", "dist_m", "path", "message", "snap_o_m", "snap_d_m", "o_lon", "o_lat", "d_lon", "d_lat",
        F.lit(placement.TREE_COLOUR if mode == "arvore" else placement.RING_COLOUR).alias("colour"), (F.lit(1_000_000) + F.col("leg_no")).alias("seq"),
    )
    links = written(full.unionByName(legs), "links")
    good = links.filter(F.col("status") == OK)
    alert = F.when(F.col("scope") == "distribuicao", placement.link_name(F.col("link"), F.col("a_ref"), F.col("b_ref"), F.col("dist_m"), gap_m)).otherwise(placement.link_name(F.col("link"), F.col("a_ref"), F.col("b_ref"), F.col("dist_m")))
    text = F.when(F.col("scope") == "distribuicao", F.concat(F.lit("Status de rota: "), "status", F.lit("\nMetragem Calculada com Flecha/Reserva."))).otherwise(
        F.concat(F.lit("Status de rota: "), "status", F.lit(f"\nTopologia: {mode.upper()}\nMetragem calculada com margem de segurança."))
    )
    cables = good.withColumn("nome", alert).withColumn("descricao", text)
    wrong = Window.partitionBy("project_id").orderBy("seq")
    exceptions = links.filter(F.col("status") != OK).withColumn("exc_no", F.row_number().over(wrong))

    # Optical check along the cables that exist.
    wires = good.select("project_id", F.when(F.col("a_id") == "OLT_0001", F.lit("olt")).otherwise(F.col("a_id")).alias("a"), F.col("b_id").alias("b"), "dist_m", "seq")
    lengths = placement.fibre_lengths(wires)
    ctos = placement.optical_check(ctos.withColumn("node", F.col("id")), lengths, config).drop("node")
    about = F.concat(
        F.lit("ID interno: "), "id", F.lit("\nHP cobertos: "), F.col("n_hp").cast("string"), F.lit(f"/{e['capacidade_hp_por_cto']}\nHC esperado (teórico): "), F.format_string("%.1f", "hc_estimado_teorico"),
        F.lit(f"\nSplitter inicial: 1x{e['splitter_cto_inicial']}\nExpansão: 1x{e['splitter_cto_expansao']}\nPON: "), F.col("pon_no").cast("string"),
        F.lit("\n\n[ORÇAMENTO ÓPTICO]\nDistância Real: "), placement.whole(F.col("fibre_m")), F.lit("m\n"), "verdict",
    )
    ctos = ctos.withColumn("descricao", about).withColumn("icone", placement.pon_icon(F.col("pon_no"), look["colorir_cto_por_pon"]))
    ceos = ceos.withColumn("icone", F.lit(placement.CEO_ICON)).withColumn("descricao", F.concat(F.lit("ID interno: "), "id", F.lit("\nPONs: "), F.col("n_pons").cast("string"), F.lit(f"/{e['pons_por_ceo']}")))
    pons = pons.withColumn("id", F.format_string("PON_%04d", "pon"))
    hybrid = streets.select("project_id").limit(0) if spans is None else spans.select("project_id").distinct()
    return Plan(members, ctos, pons, ceos, olts, cables, exceptions, edges, hybrid, config)


def report(p: Plan) -> DataFrame:
    """One JSON report for each project, with the reference layout of keys."""
    p = replace(p, ctos=written(p.ctos, "ctos-final"))  # read several times here
    e, c = p.config["engenharia"], F.col
    pair = lambda x, y: F.array(c(x), c(y))
    optic = F.struct(c("attenuation_db").alias("atenuacao_total_db"), c("signal_dbm").alias("sinal_recebido_dbm"), c("fibre_m").alias("distancia_fibra_m"), c("approved").alias("aprovado"))
    listed = lambda df, key, fields: df.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(c(key).alias("k"), F.struct(*fields).alias("v")))), lambda x: x["v"]).alias("rows"))
    ctos = listed(p.ctos, "cto", [
        "id", "nome", F.format_string("PON_%04d", "pon").alias("pon_id"), c("pon_no").alias("pon_numero"), F.format_string("CEO_%04d", "ceo").alias("ceo_id"), c("n_hp").alias("hp_atribuidos"), c("hp_ids").alias("hp_indices"),
        pair("raw_lon", "raw_lat").alias("coords_brutas"), pair("lon", "lat").alias("coords_finais"), optic.alias("orcamento_optico"),
    ])
    own = p.ctos.groupBy("project_id", "pon").agg(F.transform(F.sort_array(F.collect_list(F.struct("ss", "id"))), lambda x: x["id"]).alias("cto_ids"))
    pons = listed(p.pons.join(own, ["project_id", "pon"]), "pon", ["id", c("pon_no").alias("numero"), F.format_string("CEO_%04d", "ceo").alias("ceo_id"), "cto_ids"])
    held = p.pons.groupBy("project_id", "ceo").agg(F.transform(F.sort_array(F.collect_list(F.struct("pon_no", "id"))), lambda x: x["id"]).alias("pon_ids"))
    ceos = listed(p.ceos.join(held, ["project_id", "ceo"]), "ceo_ord", ["id", "nome", "pon_ids", pair("lon", "lat").alias("coords")])
    bad = listed(p.exceptions, "exc_no", [
        c("scope").alias("escopo"), "status", c("link").alias("tipo"), c("a_ref").alias("origem"), c("b_ref").alias("destino"), c("message").alias("mensagem"), c("snap_o_m").alias("distancia_origem_malha_m"),
        c("snap_d_m").alias("distancia_destino_malha_m"), F.array(pair("o_lon", "o_lat"), pair("d_lon", "d_lat")).alias("coords_referencia"),
    ])
    box = routing_box(p.hps.filter("hp_id is not null"), p.olts.select("project_id", c("raw_lon").alias("lon"), c("raw_lat").alias("lat")), float(e["margem_bbox_roteamento_metros"]))
    mesh = graph.node_table(p.edges).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    head = p.olts.select("project_id", F.struct("id", "nome", pair("raw_lon", "raw_lat").alias("coords_configuradas"), pair("lon", "lat").alias("coords_finais")).alias("olt"))
    full = p.ctos.groupBy("project_id").agg(F.sum("n_hp").alias("hp_total"), F.sum("n_hp").alias("hp_atribuidos"), F.count(F.lit(1)).alias("ctos_total"), F.count_if(c("n_hp") > int(e["capacidade_hp_por_cto"])).alias("ctos_acima_capacidade"), F.max("n_hp").alias("maior_ocupacao_hp_cto"))
    part = lambda df, up, cap, name, child: df.groupBy("project_id", up).agg(F.count(F.lit(1)).alias("n")).groupBy("project_id").agg(F.count(F.lit(1)).alias(f"{name}s_total"), F.count_if(c("n") > int(cap)).alias(f"{name}s_acima_capacidade"), F.max("n").alias(f"maior_ocupacao_{child}s_{name}"))
    valid = full.join(part(p.ctos, "pon", e["ctos_por_pon"], "pon", "cto"), "project_id").join(part(p.pons, "ceo", e["pons_por_ceo"], "ceo", "pon"), "project_id")
    valid = valid.select("project_id", F.struct(*valid.columns[1:], F.lit(True).alias("valido")).alias("validacao"))
    tally = p.cables.groupBy("project_id").agg(F.count_if(c("scope") == "distribuicao").alias("nd"), F.count_if(c("scope") == "backbone").alias("nb"))
    joined = ctos.withColumnRenamed("rows", "ctos")
    for df, n in ((pons, "pons"), (ceos, "ceos"), (bad, "excecoes")):
        joined = joined.join(df.withColumnRenamed("rows", n), "project_id", "left")
    joined = joined.join(tally, "project_id", "left").join(box, "project_id", "left").join(mesh, "project_id", "left").join(head, "project_id", "left").join(valid, "project_id", "left")
    joined = joined.join(p.poles.withColumn("hybrid", F.lit(True)), "project_id", "left")
    n_bad = F.when(c("excecoes").isNull(), 0).otherwise(F.size("excecoes"))
    route = F.struct(
        F.coalesce("n_nodes", F.lit(0)).alias("nos_malha_viaria"), F.array("min_lon", "min_lat", "max_lon", "max_lat").alias("bbox_consultado"), F.coalesce("hybrid", F.lit(False)).alias("modo_hibrido_postes"),
        F.lit(e.get("topologia_backbone", {}).get("modo", "arvore")).alias("topologia_backbone"), F.coalesce("nd", F.lit(0)).alias("cabos_distribuicao_validos"), F.coalesce("nb", F.lit(0)).alias("cabos_backbone_validos"),
        n_bad.alias("quantidade_excecoes"), F.when(n_bad == 0, "OK").otherwise("COM_EXCECOES").alias("status"), "excecoes",
    )
    rule = F.struct(F.lit(int(e["capacidade_hp_por_cto"])).alias("capacidade_hp"), F.lit(int(e["splitter_cto_inicial"])).alias("splitter_inicial"), F.lit(int(e["splitter_cto_expansao"])).alias("splitter_expansao"), F.lit(float(e["penetracao_estimada"])).alias("penetracao_estimada"))
    return joined.select("project_id", F.to_json(F.struct(c("project_id").alias("projeto"), "olt", route.alias("roteamento"), rule.alias("regra_cto"), "validacao", "ctos", "pons", "ceos")).alias("report"))


def routing_box(hps: DataFrame, extra: DataFrame | None, margin_m: float) -> DataFrame:
    """Each project's box around its HPs and further points, with a margin."""
    pts = hps.select("project_id", "lon", "lat")
    if extra is not None:
        pts = pts.unionByName(extra.select("project_id", "lon", "lat"))
    box = pts.groupBy("project_id").agg(F.min("lon").alias("a"), F.min("lat").alias("b"), F.max("lon").alias("c"), F.max("lat").alias("d"))
    cols = geo.expanded_box("a", "b", "c", "d", margin_m)
    return box.select("project_id", *[x.alias(n) for x, n in zip(cols, ("min_lon", "min_lat", "max_lon", "max_lat"), strict=True)])
