import datetime as dt

from scriptorium.operators import eav

ATTRS = [("invoice_date", "date", "Invoice Date", "Rechnungsdatum"), ("total_amount", "decimal", "Total Amount", "Gesamtbetrag"), ("qty", "integer", "Quantity", "Menge"), ("paid", "boolean", "Paid", "Bezahlt"), ("remarks", "text", "Remarks", "Bemerkungen")]
KV = "kv_id bigint, form_id string, scan_id bigint, key string, value string, read_at timestamp, attr string"


def frames(spark, rows):
    t = dt.datetime(2024, 1, 1)
    kv = spark.createDataFrame([(i, f, s, k, v, t + dt.timedelta(hours=h) if h is not None else None, "clash") for i, (f, s, k, v, h) in enumerate(rows)], KV)
    attrs = spark.createDataFrame(ATTRS, "attr string, dtype string, label_en string, label_de string")
    scans = spark.createDataFrame([(1, "en_US"), (2, "de_DE"), (3, "fr_FR"), (4, "en_GB"), (1, "en_US")], "scan_id bigint, locale string")
    return kv, attrs, scans


def found(spark, rows):
    kv, attrs, scans = frames(spark, rows)
    wide = eav.pivot(kv, attrs, scans, typed=False)
    return {tuple(r) for r in eav.found(wide, [a[0] for a in ATTRS]).collect()}


def values(spark, scan, key, raws):
    got = dict()
    for f, _, v in found(spark, [(str(i), scan, key, r, 0) for i, r in enumerate(raws)]):
        got[f] = v
    return [got.get(str(i)) for i in range(len(raws))]


def test_dates_follow_the_locale(spark):
    assert values(spark, 1, "Invoice Date", ["12/21/2019", "8/2/21", "May 24, 2019", "2021-07-02", "13/13/2020", "Feb 30, 2020"]) == ["2019-12-21", "2021-08-02", "2019-05-24", "2021-07-02", None, None]
    assert values(spark, 4, "Invoice Date", ["23/07/2021", "18th December 2023", "4.5.24", "5 March 2020"]) == ["2021-07-23", "2023-12-18", "2024-05-04", "2020-03-05"]
    assert values(spark, 2, "Rechnungsdatum", ["25. April 2022", "19.3.24", "3. März 2021"]) == ["2022-04-25", "2024-03-19", "2021-03-03"]
    assert values(spark, 3, "Invoice Date", ["1er mai 2020", "25 octobre 2021", "22-01-2020", "6 août 2020"]) == ["2020-05-01", "2021-10-25", "2020-01-22", "2020-08-06"]


def test_numbers_follow_the_locale(spark):
    assert values(spark, 1, "Total Amount", ["$9,002.73", "USD (1042.53)", "$-155.85", "5,853.00", "1.234,5", "pending", "007.50"]) == ["9002.73", "-1042.53", "-155.85", "5853", None, None, "7.5"]
    assert values(spark, 2, "Gesamtbetrag", ["7.260,88 €", "(270,42) €", "-463,49 EUR", "101.65"]) == ["7260.88", "-270.42", "-463.49", None]
    assert values(spark, 3, "Total", ["3 833,08 €", "1 717,26", "-8 965,50"]) == ["3833.08", "1717.26", "-8965.5"]
    assert values(spark, 1, "Qty.", ["4,498 pcs", "12.5", "0", "-0"]) == ["4498", None, "0", "0"]


def test_booleans_texts_and_no_values(spark):
    assert values(spark, 1, "Paid?", ["Yes", "☐", "✓", "x", "nein", "oui", "maybe", " N "]) == ["true", "false", "true", "true", "false", "true", None, "false"]
    assert values(spark, 1, "Remarks", ["  a  b\n c ", "", "-", "—", "N/A", "illegible", None]) == ["a b c", None, None, None, None, None, None]


def test_keys_case_marks_and_misread_glyphs(spark):
    rows = [("f", 1, k, "5", i) for i, k in enumerate(["Quanfity", "QUANTITY :", "quantity .....", "No. of units", "unknown", None])]
    kv, attrs, scans = frames(spark, rows)
    assert eav.resolve(kv, attrs, scans).count() == 4


def test_latest_readable_wins_and_failures_stay(spark):
    rows = [("f", 1, "Qty", "1", 1), ("f", 1, "Qty", "2", 3), ("f", 1, "Quantity", "3", 3), ("f", 1, "Qty", "???", 9), ("f", 1, "Qty", "n/a", 10), ("f", 1, "Qty", "8", None), (None, 1, "Qty", "4", 1)]
    kv, attrs, scans = frames(spark, rows)
    wide = {r.form_id: r for r in eav.pivot(kv, attrs, scans).collect()}
    assert wide["f"].qty == 3 and wide["f"].failed == {"qty": "???"} and wide[None].qty == 4 and wide["f"].paid is None


def test_empty(spark):
    assert found(spark, []) == set()


def test_wordings_are_a_parameter_and_unknown_keys_are_told(spark):
    import pytest

    pairs = spark.createDataFrame([("f", 1, "Wt. (net)", "5", None, 1), ("f", 1, "colour", "red", None, 2), ("f", 1, "C0LOUR:", "red", None, 3), ("f", 1, None, "x", None, 4)], "form_id string, scan_id bigint, key string, value string, read_at timestamp, kv_id bigint")
    attrs = spark.createDataFrame([("weight_kg", "decimal", "Weight", "Gewicht"), ("odd'name`x", "text", "Odd", None)], "attr string, dtype string, label_en string, label_de string")
    assert {r.key: r.n for r in eav.unknown_keys(pairs, attrs, {"weight_kg": ["wt (net)"]}).collect()} == {eav.skeleton_of("colour"): 2}
    wide = eav.pivot(pairs, attrs, typed=False, wordings={"weight_kg": ["wt (net)"]})
    assert [tuple(r) for r in eav.found(wide, ["weight_kg", "odd'name`x"]).collect()] == [("f", "weight_kg", "5")]
    with pytest.raises(ValueError, match="may mean"):
        eav.wording_table(spark, [("a", "text", "Stand 1", None), ("b", "text", "Stand l", None)])


def test_skeletons_of_driver_and_cluster_agree(spark):
    from pyspark.sql import functions as F

    words = [w for ws in eav.WORDINGS.values() for w in ws] + ["Inv. No.:", "T0tal —  Amount", "Rechn.-Datum", "fam|ly 589", "Ä_b\u00a0c"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert all(r.k == eav.skeleton_of(r.w) for r in df.select("w", eav.key_skeleton(F.col("w")).alias("k")).collect())
