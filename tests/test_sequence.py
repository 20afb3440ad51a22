import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators.encounters import encounter_base
from cohortlens.operators.sequence import sequence


def _brute(df, key, order):
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({"seq": F.row_number().over(w), "cnt": F.count(F.lit(1)).over(Window.partitionBy(key)),
                           "prv": F.lag("v").over(w), "nxt": F.lead("v").over(w)})


def _skewed(spark, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(600):
        key = 1 if i % 3 else rnd.randint(2, 40)   # key 1 holds two thirds of the rows
        rows.append((key, i, rnd.randint(0, 50), None if i % 17 == 0 else f"v{i}"))
    return spark.createDataFrame(rows, "k long, o long, t int, v string")


def _cmp(a, b):
    cols = ["k", "o", "seq", "cnt", "prv", "nxt"]
    return sorted(tuple(r) for r in a.select(*cols).collect()) == sorted(tuple(r) for r in b.select(*cols).collect())


def test_hot_key_path_equals_plain_window(spark):
    df = _skewed(spark)
    got = sequence(df, "k", ["t", "o"], seq="seq", count="cnt", prev={"prv": "v"}, nxt={"nxt": "v"},
                   hot_rows=20, slices=5)
    assert _cmp(got, _brute(df, "k", ["t", "o"]))


def test_plain_path_when_no_key_is_hot(spark):
    df = _skewed(spark)
    got = sequence(df, "k", ["t", "o"], seq="seq", count="cnt", prev={"prv": "v"}, nxt={"nxt": "v"})
    assert _cmp(got, _brute(df, "k", ["t", "o"]))


def test_exclusions_apply_before_sequencing(spark):
    cols = ["encounter_id", "patient_nbr", "readmitted", "expired_or_hospice_flag", "gender_invalid_flag"]
    rows = [(1, 7, "NO", 0, 0), (2, 7, "<30", 1, 0), (3, 7, ">30", 0, 0), (4, 8, "NO", 0, 1)]
    df = spark.createDataFrame(rows, cols)
    base = encounter_base(df, carried=["encounter_id", "patient_nbr", "readmitted"]).orderBy("encounter_id")
    got = [(r.encounter_id, r.encounter_seq, r.prior_encounter_id, r.patient_total_encounters,
            r.is_repeat_patient, r.led_to_30day_readmission) for r in base.collect()]
    # encounter 2 is excluded: it takes no sequence number; patient 8 vanishes entirely
    assert got == [(1, 1, None, 2, 1, 0), (3, 2, 1, 2, 1, 0)]


def test_sampled_hot_key_detection_is_still_exact(spark):
    df = _skewed(spark, seed=9)
    got = sequence(df, "k", ["t", "o"], seq="seq", count="cnt", prev={"prv": "v"}, nxt={"nxt": "v"},
                   hot_rows=300, slices=4)
    assert _cmp(got, _brute(df, "k", ["t", "o"]))


def test_hot_keys_with_many_rows_and_extra_columns_equal_a_plain_window(spark):
    """200,000 rows, three keys (one NULL), ties in the first order column, several seeds."""
    for seed in (1, 7):
        df = spark.range(200_000).select(
            F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("k"), F.col("id").alias("o"),
            (F.xxhash64("id", F.lit(seed)) % 50).alias("t"), F.concat(F.lit("v"), "id").alias("v"),
            F.sha2(F.col("id").cast("string"), 256).alias("extra"), (F.col("id") * 0.5).alias("extra2"))
        df = df.repartition(7, "o")
        got = sequence(df, "k", ["t", "o"], seq="seq", count="cnt", prev={"prv": "v"}, nxt={"nxt": "v"}, hot_rows=5_000)
        want = _brute(df, "k", ["t", "o"]).withColumn("cnt", F.col("cnt").cast("long"))
        cols = want.columns
        digest = F.struct(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")))
        for _ in range(2):   # every evaluation agrees
            assert got.select(*cols).select(digest).first() == want.select(digest).first()


def test_slices_are_found_through_a_tree_of_split_points(spark):
    """More split points than one node or two levels hold; a row does not meet all of its key's."""
    from cohortlens.operators.slicing import FANOUT, ordered_slices, split_points
    df = spark.range(24_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("k"),
        F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.xxhash64("id") % 5_000).alias("t"), (F.col("id") % 7).alias("o"))
    for keys in (["k"], []):
        points = {}
        for r in split_points(df, keys, ["t", "o"], 20).collect():
            points.setdefault(r["_k0"] if keys else None, []).append(((r["_o"]["t"] is not None, r["_o"]["t"]), r["_o"]["o"], r["_slice"]))
        assert all([p[2] for p in sorted(own)] == list(range(1, len(own) + 1)) for own in points.values())
        assert max(map(len, points.values())) > FANOUT ** 2
        got = ordered_slices(df, keys, ["t", "o"], 20)
        assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
        rows = got.collect()
        assert len(rows) == 24_000
        for r in rows[::37]:
            at = ((r["t"] is not None, r["t"]), r["o"])
            assert r["_slice"] == sum(p[:2] <= at for p in points[r["k"] if keys else None])
