import math

from pyspark.sql import functions as F

from cairn.functions import cols


def one(spark, **values):
    return spark.range(1).select(*(c.alias(k) for k, c in values.items())).first().asDict()


def test_casts(spark):
    got = one(spark, a=cols.parse_int(F.lit("3.7")), b=cols.parse_int_strict(F.lit("3.7")), c=cols.parse_int(F.lit("-3.7")), d=cols.parse_double(F.lit("x")), e=cols.parse_int(F.lit("")))
    assert (got["a"], got["b"], got["c"], got["e"]) == (3, None, -3, None)
    assert math.isnan(got["d"])


def test_boolean_dialects(spark):
    got = one(spark, a=cols.truthy(F.lit("yes")), b=cols.is_upper_true(F.lit("yes")), c=cols.is_lower_true(F.lit("yes")), d=cols.truthy(F.lit(None).cast("string")), e=cols.strict_bool(F.lit("No")))
    assert list(got.values()) == [True, False, False, False, False]


def test_box_reasons(spark):
    rows = [(float("nan"), 0.0, 5.0, 5.0), (5.0, 5.0, 5.0, 9.0), (-9.0, -9.0, -1.0, -1.0), (-2.0, 3.0, 50.0, 40.0), (1.2, 2.8, 10.1, 11.9)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumns({"w": F.lit(100), "h": F.lit(80)})
    args = [F.col(x) for x in "abcdwh"]
    c = cols.clamp_box(*args)
    got = df.select(cols.box_reason(*args), cols.needs_clamp(*args), c["left"], c["top"], c["right"], c["bottom"]).collect()
    assert [r[0] for r in got] == ["non_finite_bbox", "non_positive_bbox_area", "bbox_completely_outside_image", "", ""]
    assert got[2][1] and got[3][1] and not got[4][1]
    assert tuple(got[3][2:]) == (0, 3, 50, 40) and tuple(got[4][2:]) == (1, 2, 11, 12)


def test_letterbox_and_names(spark):
    got = one(spark, **cols.letterbox(F.lit(448), F.lit(100), 224))
    assert list(got.values()) == [224, 50, 0, 87, 0, 87]
    got = one(spark, **cols.roi_name(F.lit("img_1_class2_radR8_bbox0007__aug_brightness_0003_f097.png")))
    assert got == {"source_image_id": "img_1", "class_id": 2, "rad_id": "R8", "annotation_index": 7, "augmented": True, "original_roi_id": "img_1_class2_radR8_bbox0007"}


def test_vectors(spark):
    got = one(spark, a=cols.argmax(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))), v=cols.label_vector(F.array(F.lit(0), F.lit(2)), 3), t=cols.at_least(F.array(F.lit(0.5), F.lit(0.4)), F.array(F.lit(0.5), F.lit(0.5))))
    assert got == {"a": 1, "v": [1, 0, 1], "t": [1, 0]}
