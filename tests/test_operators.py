"""Operators on small fixtures: edges, golden arithmetic, sources, sinks, models."""

import datetime as dt
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.config import AlertParams, ScoreParams, load_config
from netloom.functions.severity import iso_timestamp, protocol_name, severity_by_type, severity_weighted
from netloom.operators import alerts, clean, evaluation, metrics, quality, scoring, splits
from netloom.operators.features import flow_features
from netloom.operators.flows import assemble_flows, flow_table
from netloom.operators.isolation import IsolationForest, IsolationForestModel, path_norm
from netloom.operators.ranks import exact_quantiles
from netloom.schema import FEATURE_NAMES, FLOW_CSV_SCHEMA, PACKET_SCHEMA
from netloom.sources.alerts import append_alerts, read_alerts, to_alert_rows
from netloom.sources.packets import decode_frames
from netloom.sources.tables import clean_header, read_flow_csvs, read_split, write_clean, write_report, write_split

T0 = dt.datetime(2024, 1, 1)


def packets(spark, rows):
    """Rows (seconds, src, sport, dst, dport, length, flags)."""
    data = [
        (i, T0 + dt.timedelta(microseconds=round(s * 1e6)), a, b, ap, bp, 6, n, 40, flags, 65535)
        for i, (s, a, ap, b, bp, n, flags) in enumerate(rows)
    ]
    return spark.createDataFrame(data, PACKET_SCHEMA)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# -- flows -------------------------------------------------------------------------------


def test_reversed_pair_is_one_flow_closed_by_rst(spark):
    p = packets(spark, [
        (0, "10.0.0.1", 12345, "10.0.0.2", 80, 60, 2),
        (0.001, "10.0.0.2", 80, "10.0.0.1", 12345, 60, 18),
        (0.002, "10.0.0.2", 80, "10.0.0.1", 12345, 60, 4),
    ])
    f = one(flow_features(assemble_flows(p)))
    assert (f["Total Fwd Packets"], f["Total Backward Packets"], f.close_reason) == (1.0, 2.0, "FIN/RST")
    assert (f.src_ip, f.dst_port, f["Destination Port"]) == ("10.0.0.1", 80, 80.0)


def test_benign_flow_features(spark):
    rows = [(i * 0.01, "192.168.1.100", 54321, "10.0.0.1", 80, 100, 24) for i in range(5)]
    rows += [(0.05 + i * 0.01, "10.0.0.1", 80, "192.168.1.100", 54321, 800, 24) for i in range(20)]
    f = one(flow_features(assemble_flows(packets(spark, rows))))
    assert list(f.asDict())[-78:] == list(FEATURE_NAMES)
    assert all(math.isfinite(f[n]) for n in FEATURE_NAMES)
    assert f["Total Length of Bwd Packets"] == 16000.0 and f["Fwd Packet Length Std"] == 0.0
    assert f["Flow Duration"] == 240_000.0 and f["Flow IAT Mean"] == pytest.approx(10_000)
    assert f["Down/Up Ratio"] == 4.0 and f["PSH Flag Count"] == 25.0 and f["Fwd Header Length.1"] == 200.0


def test_single_packet_flow(spark):
    f = one(flow_features(assemble_flows(packets(spark, [(0, "a", 1, "b", 2, 90, 1)]))))
    assert f["Flow Packets/s"] == pytest.approx(1e9) and f["Flow IAT Std"] == 0.0 and f.close_reason == "flush"


def test_first_packet_fin_does_not_close_and_limits_are_strict(spark):
    a = ("a", 1, "b", 2, 50)
    rows = [(0, *a, 1), (120, *a, 1)]  # a gap equal to the idle limit stays; the second FIN closes
    rows += [(121, *a, 16), (241.000001, *a, 16)]  # one microsecond beyond cuts
    flows = flow_table(assemble_flows(packets(spark, rows))).orderBy("start").collect()
    assert [(f.packets, f.close_reason) for f in flows] == [(2, "FIN/RST"), (1, "idle_timeout"), (1, "flush")]


def test_absolute_timeout_and_clock(spark):
    rows = [(i * 100, "a", 1, "b", 2, 50, 16) for i in range(9)]
    flows = flow_table(assemble_flows(packets(spark, rows)), now="2024-01-02 00:00:00").orderBy("start").collect()
    assert [(f.packets, f.close_reason) for f in flows] == [(7, "absolute_timeout"), (2, "idle_timeout")]


def test_equal_endpoints_are_forward_and_crossed_pairs_differ(spark):
    rows = [(0, "a", 1, "a", 1, 50, 16), (1, "a", 1, "a", 1, 50, 16), (2, "A", 1, "B", 2, 50, 16), (3, "A", 2, "B", 1, 50, 16)]
    f = flow_features(assemble_flows(packets(spark, rows))).orderBy("start").collect()
    assert len(f) == 3 and f[0]["Total Fwd Packets"] == 2.0


def test_real_active_idle(spark):
    rows = [(s, "a", 1, "b", 2, 50, 16) for s in (0, 1, 2, 20, 21, 50)]
    f = one(flow_features(assemble_flows(packets(spark, rows)), real_active_idle=True, activity_s=5))
    assert (f["Idle Max"], f["Idle Min"], f["Active Max"]) == (29e6, 18e6, 2e6)


def test_decode_frames(spark):
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 52, 0, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 200]))
    tcp = struct.pack("!HHIIBBHHH", 54321, 443, 1, 2, 8 << 4, 0x38, 29200, 0, 0) + bytes(12)
    good = bytes(12) + b"\x08\x00" + ip + tcp + b"payload"
    arp = bytes(12) + b"\x08\x06" + bytes(40)
    short = good[:40]
    df = spark.createDataFrame([(1, T0, good), (2, T0, arp), (3, T0, short)], "packet_id long, ts timestamp, frame binary")
    r = one(decode_frames(df))
    assert (r.src_ip, r.dst_ip, r.src_port, r.dst_port) == ("10.0.0.1", "10.0.0.200", 54321, 443)
    assert (r.length, r.header_len, r.tcp_flags, r.window_size) == (len(good), 52, 0x38, 29200)


# -- severity, scores, gates ------------------------------------------------------------------


@pytest.mark.parametrize("kind,conf,iso,want", [
    ("DDoS", 0.9, 0.1, "CRITICAL"), ("DDoS", 0.6, 0.1, "HIGH"), ("DDoS", 0.4, 0.1, "MEDIUM"), ("PortScan", 0.4, 0.1, "LOW"),
    ("PortScan", 0.4, 0.8, "MEDIUM"), ("Never Seen", 0.9, 0.0, "MEDIUM"), ("UNKNOWN_ATTACK", 0.1, 0.0, "CRITICAL"),
    ("DDoS", 0.9, 0.9, "CRITICAL"), ("Web Attack – XSS", 0.75, 0.0, "HIGH"),
])
def test_severity_by_type(spark, kind, conf, iso, want):
    assert one(spark.range(1).select(severity_by_type(F.lit(kind), F.lit(conf), F.lit(iso)).alias("s"))).s == want


def test_small_expressions(spark):
    r = one(spark.range(1).select(
        severity_weighted(F.lit(1.5), F.lit(-1.0)).alias("w"), protocol_name(F.lit(47)).alias("p"),
        iso_timestamp(F.lit(dt.datetime(2024, 1, 2, 3, 4, 5, 678901))).alias("t"),
    ))
    assert (r.w, r.p, r.t) == ("MEDIUM", "47", "2024-01-02T03:04:05.678+00:00")


def test_scores_keep_bad_rows_apart(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0, 0.0, "Bot", 0.9), (2, 1.0, 1.0, 0.7, "Bot", 0.9), (3, 1.0, 1.0, 0.69, "Bot", 0.9), (4, None, 1.0, 0.1, "Bot", 0.9)],
        "id int, rf double, xgb double, iso double, class_name string, class_confidence double",
    )
    r = {x.id: x for x in scoring.score_stacking(df).collect()}
    assert [r[i].attack_type for i in (1, 2, 3, 4)] == ["BENIGN", "UNKNOWN_ATTACK", "Bot", "BENIGN"]
    assert r[2].severity == "CRITICAL" and r[2].attack_confidence == r[2].meta_probability
    assert r[1].attack_confidence == 1.0 and r[4].error == "1 missing feature(s): rf" and r[3].error is None


def test_gates_in_order(spark):
    df = spark.createDataFrame(
        [(1, False, "NONE", "BENIGN", 0.1, 80), (2, True, "LOW", "Bot", 0.9, 80), (3, True, "HIGH", "Bot", 0.4, 80),
         (4, True, "HIGH", "Bot", 0.9, 80), (5, True, "HIGH", "DDoS", 0.9, 53), (6, True, "HIGH", "DDoS", 0.9, 80)],
        "id int, is_attack boolean, severity string, attack_type string, meta_probability double, dst_port int",
    )
    params = AlertParams(min_severity="MEDIUM", suppressed_types=("Bot",), suppressed_ports=(53,))
    got = [r.suppress_reason for r in alerts.alert_rules(df, params).orderBy("id").collect()]
    assert got == ["BENIGN flow", "severity LOW < min MEDIUM", "meta_probability 0.400 < min 0.500",
                   "attack_type 'Bot' suppressed", "dst_port 53 suppressed", None]


def test_dedup_window_edges(spark):
    rows = [(i, T0 + dt.timedelta(seconds=s), "a", "b", "DDoS") for i, s in enumerate((0, 30, 59.999999, 60, 100, 121))]
    df = spark.createDataFrame(rows, "flow_id long, ts timestamp, src_ip string, dst_ip string, attack_type string")
    first = {r.flow_id for r in alerts.dedup_alerts(df, 60).where("is_first").collect()}
    assert first == {0, 3, 5}
    windows = alerts.suppression_summary(alerts.dedup_alerts(df, 60)).orderBy("first_seen").collect()
    assert [w["count"] for w in windows] == [3, 2, 1]
    assert AlertParams(dedup_window_s=0).dedup_window_s == 1.0


def test_empty_statistics(spark):
    df = spark.createDataFrame([], "outcome string, severity string")
    assert one(alerts.alert_stats(df)).alert_rate == 0.0
    with pytest.raises(ValueError):
        alerts.recent_alerts(df, 1001)


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"meta_learner_threshold": 0.6, "alert_dedup_window_s": 0, "alert_suppressed_ports": [53]}))
    c = load_config(str(path))
    assert (c.scores.meta_threshold, c.alerts.dedup_window_s, c.alerts.suppressed_ports) == (0.6, 1.0, (53,))
    with pytest.raises(ValueError):
        ScoreParams(meta_threshold=1.0)
    with pytest.raises(ValueError):
        ScoreParams(iso_min=1, iso_max=1)


# -- evaluation --------------------------------------------------------------------------------


def test_published_confusion_counts(spark):
    df = spark.createDataFrame([(429_362, 277, 159, 85_014)], "tn long, fp long, fn long, tp long")
    r = one(evaluation.rates(df))
    assert (round(r.precision, 5), round(r.recall, 5), round(r.f1, 5)) == (0.99675, 0.99813, 0.99744)


def test_step_average_precision_and_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    r = one(evaluation.auc_scores(df, "s", "y"))
    assert r.pr_auc == pytest.approx(0.8333333) and r.roc_auc == pytest.approx(0.75)
    flat = spark.createDataFrame([(0.5, 0), (0.5, 1)], "s double, y int")
    assert one(evaluation.roc_auc(flat, "s", "y")).roc_auc == 0.5
    best = one(evaluation.best_f1_threshold(evaluation.pr_curve(df, "s", "y")))
    assert best.threshold == 0.35


def test_curve_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(1 - 10 ** -rng.uniform(0, 12) if rng.random() < 0.5 else rng.uniform(-0.5, 1.5) ** 3, rng.randrange(2)) for _ in range(800)]
    df = spark.createDataFrame(rows, "s double, y int")
    got = {r.threshold: (r.tp, r.fp) for r in evaluation.pr_curve(df, "s", "y").collect()}
    want = {t: (sum(y for s, y in rows if s >= t), sum(1 - y for s, y in rows if s >= t)) for t, _ in rows}
    assert got == want


def test_auc_agrees_with_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(2000).selectExpr("cast(rand(1) < 0.3 as double) as y", "round(rand(2), 2) as s")
    ours = one(evaluation.roc_auc(df, "s", "y")).roc_auc
    theirs = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(df)
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_class_without_predictions(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "y string, p string")
    r = {x["class"]: x for x in evaluation.per_class_report(df, "y", "p").collect()}
    assert (r["b"].precision, r["b"].recall, r["b"].support, r["b"].rare) == (0.0, 0.0, 1, True)


# -- cleaning, splits, metrics -------------------------------------------------------------------


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(size=500) * 1e6, rng.normal(size=501) * 1e-6, np.zeros(50), -np.ones(7)])
    df = spark.createDataFrame([(float(x), "g") for x in data], "v double, g string")
    for p in (0.0, 0.25, 0.5, 0.99, 1.0):
        assert one(exact_quantiles(df, ["g"], ["v"], p)).v == pytest.approx(float(np.quantile(data, p)), rel=1e-12, abs=1e-18)


def test_all_null_column_has_null_median(spark):
    df = spark.createDataFrame([("f", 1.0, None), ("f", 3.0, None)], "source_file string, a double, b double")
    m = clean.fit_medians(df, ["a", "b"])
    assert (one(m).a, one(m).b) == (2.0, None)
    assert one(clean.impute_at_inference(df.limit(1), {}, ["b"])).b == 0.0


def test_validate_names_first_missing(spark):
    df = spark.createDataFrame([(1.0,)], "`Flow Duration` double")
    with pytest.raises(ValueError, match="77 missing feature.*Destination Port"):
        clean.validate_features(df)


def test_split_is_exact_with_hot_copies(spark):
    df = spark.range(1000).selectExpr("'BENIGN' as label", "cast(if(id < 700, 1, id) as double) as v")
    df = df.unionByName(spark.range(40).selectExpr("'Bot' as label", "cast(id as double) as v"))
    got = splits.stratified_split(df, "label", {"train": 0.7, "val": 0.1, "test": 0.2})
    n = {(r.label, r.split): r["count"] for r in got.groupBy("label", "split").count().collect()}
    assert [n[("BENIGN", s)] for s in ("train", "val", "test")] == [700, 100, 200]
    assert [n[("Bot", s)] for s in ("train", "val", "test")] == [28, 4, 8]


def test_histogram_quantile_edges(spark):
    df = spark.createDataFrame([(0.05,), (3.0,), (900.0,)], "latency_ms double")
    h = metrics.latency_histogram(df)
    assert one(metrics.histogram_quantile(h, 0.99)).value == 500.0
    assert one(metrics.histogram_quantile(h, 0.5)).value == pytest.approx(2 + 3 * 0.5)
    empty = metrics.latency_histogram(df.limit(0))
    assert one(metrics.histogram_quantile(empty, 0.5)).value is None


def test_csv_round_trip(spark, tmp_path):
    header = [f" {n}" for n in FEATURE_NAMES]
    header[FEATURE_NAMES.index("Fwd Header Length.1")] = " Fwd Header Length"
    assert clean_header([*header, "Label"]) == [*FEATURE_NAMES, "Label"]
    row = ["80", *["1.5"] * 77, "BENIGN "]
    inf, nan = list(row), list(row)
    inf[14], nan[15], inf[-1] = "Infinity", "NaN", "Web Attack � XSS"
    lines = [",".join([*header, "Label"]), *(",".join(r) for r in (row, row, inf, nan))]
    (tmp_path / "day.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "day_clean.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    df = read_flow_csvs(spark, str(tmp_path))
    assert df.count() == 4 and df.columns[:-1] == FLOW_CSV_SCHEMA.names
    assert df.where("`Flow Bytes/s` IS NULL").count() == 1 and df.where("`Flow Packets/s` IS NULL").count() == 1
    done = clean.clean_table(df, label="Label")
    labels = sorted(r.Label for r in done.collect())
    # The imputed rows equal the plain one, except for the label.
    assert labels == ["BENIGN", "Web Attack - XSS"]
    write_clean(done, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    gate = {r.check: r.status for r in quality.quality_gate(done.drop("source_file"), label="Label").collect()}
    assert gate["verdict"] == "PASS" and gate["labels"] == "WARN"


def test_split_and_report_tables(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "if(id < 8, 'train', 'test') as split")
    write_split(df, str(tmp_path / "s"))
    part = read_split(spark, str(tmp_path / "s"), "test", ["id"])
    assert part.count() == 2 and "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().toString()
    write_report(df, str(tmp_path / "r"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 10


def test_alert_table_is_idempotent_and_evolves(spark, tmp_path):
    row = (T0, "a", "b", 1, 2, 6, "DDoS", 0.9, 0.9, 0.9, 0.9, 0.8, 0.1, "CRITICAL")
    df = spark.createDataFrame([row], "ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int,"
                               " attack_type string, attack_probability double, rf_probability double, xgb_probability double,"
                               " meta_probability double, attack_confidence double, iso_score double, severity string")
    rows = to_alert_rows(df)
    path = str(tmp_path / "alerts")
    append_alerts(rows, path, 0)
    append_alerts(rows, path, 0)  # a replayed batch
    append_alerts(rows.drop("rf_probability", "xgb_probability", "meta_probability"), path, 1)
    got = read_alerts(spark, path)
    assert got.count() == 2 and sorted(r.rf_probability for r in got.collect()) == [0.0, 0.9]
    assert alerts.recent_alerts(got, 1).count() == 1


# -- isolation forest ------------------------------------------------------------------------------


def test_isolation_forest(spark, tmp_path):
    df = spark.range(3000).selectExpr("array(randn(1), randn(2)) as scaled", "false as odd")
    model = IsolationForest(numTrees=60, subsample=128, seed=7).fit(df)
    odd = spark.range(20).selectExpr("array(9.0D + rand(3), -9.0D) as scaled", "true as odd")
    r = {x.odd: x.d for x in model.transform(df.unionByName(odd)).groupBy("odd").agg(F.avg("iso_decision").alias("d")).collect()}
    assert r[True] < 0 < r[False]
    model.save_table(spark, str(tmp_path / "m"))
    again = IsolationForestModel.load_table(spark, str(tmp_path / "m"))
    same = [m.transform(odd).agg(F.sum("iso_decision").alias("s")).first().s for m in (model, again)]
    assert same[0] == pytest.approx(same[1])
    assert path_norm(2) == 1.0 and path_norm(1) == 0.0 and float(path_norm(256)) == pytest.approx(10.2448, abs=1e-3)


def test_isolation_sample_is_exact_and_the_same_for_any_partitioning(spark):
    from netloom.operators.isolation import _candidates, _draw, _grow

    rows = [[float(k % 37), float(k % 11)] for k in range(900)] + [[5.0, 5.0]] * 300
    df = spark.createDataFrame([(r,) for r in rows], "scaled array<double>")
    models = [IsolationForest(numTrees=30, subsample=64, seed=3).fit(df.repartition(p)) for p in (1, 7)]
    assert models[0].nodes.equals(models[1].nodes)
    roots = models[0].nodes[models[0].nodes["node"] == 0]
    assert len(roots) == 30 and set(roots["size"]) == {64}
    whole = IsolationForest(numTrees=3, subsample=5000, seed=3).fit(df)
    assert set(whole.nodes[whole.nodes["node"] == 0]["size"]) == {1200}
    # The trees are those that grow from the drawn sample, written out row by row.
    counts = df.selectExpr("scaled AS x", "xxhash64(scaled) AS h1", "xxhash64(3, scaled) AS h2").groupBy("h1", "h2").agg(
        F.count("*").alias("copies"), F.first("x").alias("x")).collect()
    by = {(r.h1, r.h2): r.x for r in counts}
    share = (64 + 6 * 64**0.5 + 10) / 1200
    hit = []
    for r in spark.createDataFrame([(r.h1, r.h2, r.copies) for r in counts], "h1 long, h2 long, copies long").selectExpr(
            "h1", "h2", "copies", "pmod(xxhash64(3, h2, h1), 4503599627370496L) / 4503599627370496D AS u").collect():
        if r.u >= (1 - share) ** (r.copies * 30):
            hit.append((r.h1, r.h2, r.copies))
    picked = _draw(hit, 30, 64, share, 3)
    assert picked.groupby("tree")["take"].sum().tolist() == [64] * 30
    for tree, own in picked.groupby("tree"):
        x = np.array([by[h] for h, n in zip(zip(own.h1, own.h2), own["take"]) for _ in range(n)])
        want = _grow(tree, x, 6, 3)
        got = models[0].nodes[models[0].nodes["tree"] == tree].reset_index(drop=True)
        assert want[["feature", "threshold", "size"]].values.tolist() == got[["feature", "threshold", "size"]].values.tolist()
    # Draws follow the binomial law: mean and share of rows without any.
    n, share = 40, 0.03
    k = [len(_candidates(h, 9, 2, 20, share, 1)[0]) for h in range(4000)]
    assert abs(np.mean(k) - n * share / (1 - (1 - share) ** n)) < 0.06


def test_early_exit_runs_the_models_once(spark):
    from netloom.operators.scoring import early_exit

    @F.pandas_udf("double")
    def slow(x):
        return x * 1.0

    df = spark.range(100).withColumn("p", slow(F.col("id").cast("double")))
    df = df.withColumns({"is_attack": F.col("p") >= 50, "_unknown": F.col("p") >= 90})
    out = early_exit(df, lambda known: known.withColumns({"class_name": F.lit("Bot"), "class_confidence": F.lit(0.9)}))
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.is_attack, r._unknown, r.class_name) for r in out.collect()} == {(False, False, None), (True, True, None), (True, False, "Bot")}


def test_frequent_talkers_are_exact(spark):
    from netloom.operators import traffic

    hot = spark.range(40_000).selectExpr("concat('10.0.0.', cast(floor(sqrt(id % 400)) as string)) AS src_ip")
    rare = spark.range(60_000).selectExpr("concat('x', cast(id as string)) AS src_ip")
    df = hot.unionByName(rare).unionByName(spark.createDataFrame([(None,)] * 50, "src_ip string"))
    want = traffic.top_talkers(df.where("src_ip IS NOT NULL"), "src_ip", 10).collect()
    for tracked in (512, 4096):
        assert traffic.frequent_talkers(df, "src_ip", 10, tracked).collect() == want
    flat = rare.limit(3000)  # nothing is frequent: all are counted
    assert traffic.frequent_talkers(flat, "src_ip", 10, 64).collect() == traffic.top_talkers(flat, "src_ip", 10).collect()
    assert traffic.frequent_talkers(flat.limit(0)).collect() == []
    parts = traffic.talker_sketch(hot.withColumn("hour", F.hash("src_ip") % 3), "src_ip", 512, ["hour"])
    assert {r["item"] for r in traffic.merged_talkers(parts, 5, 512).collect()} == {f"10.0.0.{k}" for k in range(15, 20)}


def test_latency_sketches_merge_within_their_error(spark):
    df = spark.range(50_000).selectExpr("timestamp_seconds(1700000000 + id) AS ts", "exp(rand(4) * 8) AS latency_ms", "id % 2 AS path")
    df = df.unionByName(spark.createDataFrame([(T0, None, 0)], "ts timestamp, latency_ms double, path long"))
    hourly = metrics.latency_sketches(df, by=["path"])
    assert hourly.count() == df.where("latency_ms IS NOT NULL").selectExpr("path", "date_trunc('hour', ts) AS h").distinct().count()
    for by in ([], ["path"]):
        for r in metrics.merged_latency(hourly, by).collect():
            own = df if not by else df.where(F.col("path") == r.path)
            n = own.where("latency_ms IS NOT NULL").count()
            assert r.samples == n
            for p in (50, 95, 99):
                assert abs(own.where(F.col("latency_ms") <= r[f"p{p}_ms"]).count() / n - p / 100) <= 2 * metrics.rank_error()


def test_small_tables_are_broadcast(spark):
    """A join on two classes does not leave the rows in two tasks."""
    from netloom.operators.splits import stratified_split, with_class_weight

    rows = spark.range(0, 4000, 1, 8).selectExpr("id", "if(id % 3 = 0, 1, 0) AS attack")
    weighted = with_class_weight(rows, "attack")
    assert sum(1 for p in weighted.rdd.glom().map(len).collect() if p) == 8
    assert weighted.groupBy("attack").agg({"weight": "max"}).orderBy("attack").collect()[1][1] == 4000 / (2 * 1334)
    assert "BroadcastHashJoin" in stratified_split(rows, "attack")._jdf.queryExecution().executedPlan().toString()
