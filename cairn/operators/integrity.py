"""Integrity of predictions, splits, thresholds and master tables: every fault as a row or a named check."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import cols
from cairn.operators.audits import stacked
from cairn.operators.validate import first_violation, probability_reason


def prediction_errors(rows: DataFrame, key: str, names: dict[int, str], tolerance: float = 1e-5) -> DataFrame:
    """(key, error) of prediction rows, one for each rule that a row breaks.

    ``rows`` has true_class_id, true_class_name, predicted_class_id, predicted_class_name, probabilities, confidence and
    is_correct. Errors: invalid_class (a number that ``names`` lacks, or null), class_name_mismatch, the reasons of
    ``probability_reason``, wrong_length, not_the_top (the predicted class isn't the first greatest probability),
    confidence_mismatch (it isn't that probability), correctness_mismatch, and duplicate_key for each row of a repeated key.
    """
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    true, called, p = F.col("true_class_id").cast("int"), F.col("predicted_class_id").cast("int"), F.col("probabilities")
    name = lambda c: F.try_element_at(known, c)
    invalid = name(true).isNull() | name(called).isNull()
    differs = lambda c, told: name(c).isNotNull() & ~name(c).eqNullSafe(F.col(told))
    reason = probability_reason(p, tolerance)
    sound, top = reason == "", cols.argmax(p)
    off = F.abs(F.col("confidence").cast("double") - F.array_max(p)) > tolerance
    faults = {
        "invalid_class": invalid,
        "class_name_mismatch": differs(true, "true_class_name") | differs(called, "predicted_class_name"),
        "wrong_length": sound & (F.size(p) != len(names)),
        "not_the_top": sound & (top != called),
        "confidence_mismatch": sound & F.coalesce(off, F.lit(True)),
        "correctness_mismatch": ~F.col("is_correct").eqNullSafe(true == called),
    }
    found = F.array_compact(F.array(F.when(~sound, reason), *(F.when(c, F.lit(n)) for n, c in faults.items())))
    own = rows.select(key, F.explode(found).alias("error"))
    several = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return own.unionByName(rows.select(key).join(several, key).withColumn("error", F.lit("duplicate_key")))


def split_integrity(rows: DataFrame, sizes: dict[str, int], unique: list[str], apart: list[str], labels: dict[str, Column], split: str = "split") -> DataFrame:
    """(check, passed, n) of a table of split rows; ``compare.gate`` turns them into one verdict.

    master_rows and <split>_rows (n is their number) against ``sizes``; unknown_split (rows of other or null splits);
    duplicate_<field> of ``unique`` (rows beyond the first of a value); <split>_<split>_<field> of ``apart`` (values that
    both hold); <split>_<label>_positive and _negative (n rows of which must be above 0). Values meet by key once for each
    field, whatever the number of pairs; nulls are no values.
    """
    names = list(sizes)
    own = F.col(split)
    counts = [("master_rows", F.count("*"), sum(sizes.values())), *((f"{s}_rows", F.count_if(own == s), n) for s, n in sizes.items())]
    checks = [F.struct(F.lit(c).alias("check"), (v == n).alias("passed"), v.alias("n")) for c, v, n in counts]
    other = F.count_if(~F.coalesce(own.isin(names), F.lit(False)))
    checks.append(F.struct(F.lit("unknown_split").alias("check"), (other == 0).alias("passed"), other.alias("n")))
    for s in names:
        for label, holds in labels.items():
            for sign, yes in (("positive", F.coalesce(holds, F.lit(False))), ("negative", ~F.coalesce(holds, F.lit(False)))):
                n = F.count_if((own == s) & yes)
                checks.append(F.struct(F.lit(f"{s}_{label}_{sign}").alias("check"), (n > 0).alias("passed"), n.alias("n")))
    parts = [rows.agg(F.array(*checks).alias("x")).select(F.inline("x"))]
    for field in dict.fromkeys([*unique, *apart]):
        held = rows.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("_c"), *(F.max(own == s).alias(f"_in_{s}") for s in names))
        found = [(f"duplicate_{field}", F.sum(F.col("_c") - 1))] if field in unique else []
        found += [(f"{a}_{b}_{field}", F.count_if(F.col(f"_in_{a}") & F.col(f"_in_{b}"))) for a, b in combinations(names, 2)] if field in apart else []
        n = [(c, F.coalesce(v, F.lit(0))) for c, v in found]
        parts.append(held.agg(F.array(*(F.struct(F.lit(c).alias("check"), (v == 0).alias("passed"), v.alias("n")) for c, v in n)).alias("x")).select(F.inline("x")))
    return stacked(parts)


def manifest_checks(rows: DataFrame, index: str, required: list[str], unique: list[str], per_class: dict, label: str = "class_id") -> DataFrame:
    """(check, passed, n) of a manifest: n counts what breaks the check, or the rows of a class.

    index_null, index_repeated (rows beyond the first of an index) and index_gaps (numbers from 0 to the greatest one that
    no row has); blank_<column> of ``required``; duplicate_<column> of ``unique`` (blanks are none); class_<k>_rows against
    ``per_class``, and other_classes (rows of none of them). Sums and groups only; no row order is relied upon.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    check = lambda name, passed, n: F.struct(F.lit(name).alias("check"), passed.alias("passed"), n.cast("long").alias("n"))
    none = lambda name, n: check(name, F.coalesce(n, F.lit(0)) == 0, F.coalesce(n, F.lit(0)))
    own = [none("index_null", F.count_if(F.col(index).isNull())), *(none(f"blank_{c}", F.count_if(blank(c))) for c in required)]
    for k, n in per_class.items():
        held = F.count_if(F.col(label) == k)
        own.append(check(f"class_{k}_rows", held == n, held))
    own.append(none("other_classes", F.count_if(~F.coalesce(F.col(label).isin(list(per_class)), F.lit(False)))))
    parts = [rows.agg(F.array(*own).alias("x")).select(F.inline("x"))]
    numbers = rows.where(F.col(index).isNotNull()).groupBy(F.col(index).alias("_i")).agg(F.count("*").alias("_c"))
    gaps = F.max("_i") + 1 - F.count_if(F.col("_i") >= 0)
    parts.append(numbers.agg(F.array(none("index_repeated", F.sum(F.col("_c") - 1)), none("index_gaps", gaps)).alias("x")).select(F.inline("x")))
    for c in unique:
        several = rows.where(~blank(c)).groupBy(c).agg(F.count("*").alias("_c"))
        parts.append(several.agg(F.array(none(f"duplicate_{c}", F.sum(F.col("_c") - 1))).alias("x")).select(F.inline("x")))
    return stacked(parts)


def threshold_reason(payload: Column, names: list[str]) -> Column:
    """Why a JSON text is no export of thresholds from validation; empty text if it is one.

    In turn: no_json, not_validation (source_split isn't validation, or test_used isn't false), no_thresholds, wrong_keys
    (not just 0 to the number of classes less one), out_of_range (not a finite number within 0 and 1), no_audit (not one
    entry a class), audit_mismatch (an entry's class_id, class_name or threshold is another).
    """
    k = len(names)
    got = F.from_json(payload, "source_split string, test_used boolean, thresholds map<string,double>, per_class_audit array<struct<class_id:int,class_name:string,threshold:double>>")
    t = got["thresholds"]
    values = F.array(*(F.try_element_at(t, F.lit(str(i))) for i in range(k)))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    entries = F.transform(got["per_class_audit"], lambda e, i: (e["class_id"] == i) & (e["class_name"] == F.get(F.array(*map(F.lit, names)), i)) & (e["threshold"] == F.get(values, i)))
    rules = {
        "no_json": F.try_parse_json(payload).isNull(),
        "not_validation": ~F.coalesce((got["source_split"] == "validation") & ~got["test_used"], F.lit(False)),
        "no_thresholds": t.isNull(),
        "wrong_keys": ~F.array_sort(F.map_keys(t)).eqNullSafe(F.array_sort(F.array(*(F.lit(str(i)) for i in range(k))))),
        "out_of_range": bad,
        "no_audit": ~F.coalesce(F.size(got["per_class_audit"]) == k, F.lit(False)),
        "audit_mismatch": ~F.forall(entries, lambda x: F.coalesce(x, F.lit(False))),
    }
    return first_violation(rules)


def master(manifest: DataFrame, final: DataFrame, manual: DataFrame, crop: str = "source_crop_path", output: str = "output_path") -> DataFrame:
    """The manifest with manual_crop_review_status, manual_output_review_status, include_for_model and ``error``.

    ``final`` (crop, manual_review_status, include) says which crops are taken; ``manual`` (output, review_status) reviews
    outputs; a path that either has several times takes the greatest status. An output without a review is not_sampled.
    error: missing_from_final, conversion_not_success (the manifest's conversion_status), or empty text.
    """
    taken = final.where(F.col("include")).groupBy(crop).agg(F.max("manual_review_status").alias("_status"), F.lit(True).alias("_taken"))
    seen = manual.groupBy(output).agg(F.max("review_status").alias("_seen"))
    out = manifest.join(taken, crop, "left").join(seen, output, "left")
    there = F.coalesce("_taken", F.lit(False))
    error = F.when(~there, "missing_from_final").when(~F.col("conversion_status").eqNullSafe("success"), "conversion_not_success").otherwise("")
    columns = {"manual_crop_review_status": F.coalesce("_status", F.lit("")), "manual_output_review_status": F.coalesce("_seen", F.lit("not_sampled")), "include_for_model": there, "error": error}
    return out.withColumns(columns).drop("_status", "_taken", "_seen")
