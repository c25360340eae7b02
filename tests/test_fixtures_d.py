"""Hand-made cases from FIXTURES part D: labels with other pad ids (D7) and
metric series with nulls, NaN and infinity (D9)."""

from tessera.operators import runlog as rl
from tessera.operators import samples as smp


def test_labels_pad_not_zero(spark):
    df = spark.createDataFrame([([1, 5, 7, 2, 7, 7],)], "ids array<int>")
    # pad = 7, ignore = -100: positions whose input is 7 are ignored, even a real 7
    got = df.select(smp.make_labels("ids", 6, pad_token_id=7, ignore_index=-100)).first()[0]
    assert list(got) == [5, 7, -100, 7, -100, -100]


def test_metric_series_nulls_nan_inf(spark):
    rows = [("train", 1, 1, 2.0), ("train", 2, 2, float("nan")), ("train", 3, 3, float("inf")),
            ("train", 4, 4, 1.0), ("val", 1, 1, None), ("val", 2, 2, None)]
    df = spark.createDataFrame(rows, "series string, ts long, event_id long, loss double")
    fin = rl.mean_finite(df.where("series = 'train'"), "loss").first()
    assert fin.mean_loss == 1.5 and fin.finite_points == 2
    none = rl.mean_finite(df.where("series = 'val'"), "loss").first()
    assert none.mean_loss is None and none.finite_points == 0
    cur = {r.series: r.current for r in rl.current_value(df, ["series"], "loss", ["ts", "event_id"]).collect()}
    assert cur == {"train": 1.0}  # an all-null series has no current value
