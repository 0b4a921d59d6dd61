import pytest
from pyspark.sql import functions as F

from sigspark.operators import catalogue as cat
from sigspark.operators import metrics as met
from sigspark.operators import sampling as smp
from sigspark.operators import scoring as sc


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*columns).collect()]


def test_file_names(spark):
    df = spark.createDataFrame([("a/IQdata_sample123_target4_snr-14.pt",), ("other.pt",)], "filepath string")
    out = cat.parse_noisy_names(df)
    assert {(r.sample_id, r.target_raw, r.snr) for r in out.collect()} == {(123, 4, -14), (None, None, None)}
    with pytest.raises(Exception, match="not a capture name"):
        cat.parse_noisy_names(df, strict=True).collect()


def test_manifest_filter_and_index(spark):
    names = [f"IQdata_sample{i}_target{t}_snr{s}.pt" for i, t, s in ((1, 0, -10), (2, 0, 20), (3, 4, 24))]
    df = cat.parse_noisy_names(spark.createDataFrame([(n,) for n in names], "filepath string"))
    assert rows(cat.label_index(cat.snr_slice(df, low=0)), "sample_id", "label_idx") == [(2, 0), (3, 1)]


def test_split_and_replay_sizes(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "capture_id long, label_idx int")
    sizes = {r.split: r["count"] for r in smp.stratified_split(df, 1, 0.2, 0.25).groupBy("split").count().collect()}
    assert sizes == {"train": 18, "val": 6, "test": 6}
    train = smp.stratified_split(df, 1, 0.2, 0.25).filter("split = 'train'")
    assert [r["count"] for r in smp.balanced_replay(train, 1, 8).groupBy("label_idx").count().collect()] == [8, 8, 8]


def test_snr_traces(spark):
    df = spark.createDataFrame([("a", "a", 0), ("a", "a", 10), ("b", "a", 0), ("b", "a", 10)], "y_true string, y_pred string, snr int")
    out = met.ranked_peaks(df).orderBy("rank").collect()
    assert [(r.y_true, r.peak, r.peak_snr) for r in out] == [("a", 100.0, 0), ("b", 0.0, None)]


def test_small_class_split_and_empty_class(spark):
    df = spark.createDataFrame([(i, 0 if i < 2 else 1 if i < 5 else 2) for i in range(12)], "capture_id long, label_idx int")
    out = {(r.label_idx, r.split): r["count"] for r in smp.class_split(df, 3).groupBy("label_idx", "split").count().collect()}
    assert out == {(0, "train"): 2, (1, "train"): 1, (1, "val"): 1, (1, "test"): 1, (2, "train"): 5, (2, "val"): 1, (2, "test"): 1}
    named = df.withColumn("class_name", F.concat(F.lit("c"), "label_idx"))
    with pytest.raises(Exception, match="no rows"):
        smp.sweep_selection(named, ["c0", "c9"], 1, 3).collect()
    with pytest.raises(ValueError, match="above 0"):
        smp.stratified_fraction(df, 0, 1)


def test_repair_never_goes_by_name_alone(spark):
    manifest = spark.createDataFrame([("x/p.iq", "a"), ("gone/p.iq", "b"), ("gone/q.iq", "a"), ("y/p.iq", "a")], "filepath string, label string")
    listing = spark.createDataFrame([("x/p.iq", "a"), ("y/p.iq", "b"), ("z/p.iq", "b")], "path string, label string")
    assert rows(cat.repaired(manifest, listing), "filepath", "label") == [("x/p.iq", "a"), ("y/p.iq", "b")]


def test_top_levels_without_any_ratio(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, snr double")
    assert cat.top_snr_levels(df, 2).count() == 2
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, 5.0), (4, 4.0)], "id int, snr double")
    assert rows(cat.top_snr_levels(df, 2), "id") == [(3,), (4,)]


def test_class_files_and_numbers(spark):
    text = spark.createDataFrame([("classes = ['x',\n 'y z']\n",)], "value string")
    assert rows(cat.class_table(text), "class_idx", "class_name") == [(0, "x"), (1, "y z")]
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.0,)], "x double")
    assert [r.c for r in df.select(cat.clean_number(F.col("x")).alias("c")).collect()] == [0.0, cat.FLOAT_MAX, -cat.FLOAT_MAX, 0.0, 2.0]


def test_background_table(spark):
    events = [("wifi", "Noise", False, 0.9, 10.0)] * 3 + [("wifi", "DJI", True, 0.99, 12.0)]
    df = spark.createDataFrame(events, "condition string, prediction string, alert boolean, non_noise_confidence double, snr_db double")
    (r,) = met.event_summary(df, "condition").collect()
    assert (r.events, r.alerts, r.no_alerts, r.alert_rate_pct, r.max_non_noise_confidence, r.mean_snr_db, r.top_predictions) == (4, 1, 3, 25.0, 0.99, 10.5, "Noise:3,DJI:1")


def test_trial_log(spark):
    lines = ["TX sample: a b", "decision=keep", "Capture power -12.50 dB, peak 0.50, I clip 0.10%, Q clip 0.20%, |IQ|>=1 0.00%", "RF prediction=DJI confidence=0.5 top=x", "RF prediction=Noise confidence=0.6 top=y z", "nothing"]
    (r,) = sc.parsed_trials(spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "trial int, line_no int, line string")).collect()
    assert (r.tx_sample, r.decision, r.capture_power_db, r.prediction, r.top, r.target_class) == ("a b", "decision=keep", "-12.50", "Noise", "y z", None)
