"""Wide-table load."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.features import rounded
from registry.sqlbase import query
from riskweave import dataset
from riskweave.operators.boosting import Settings
from riskweave.plans import jobs, models, wide
from riskweave.session import materialize, run_dir
from riskweave.sinks.warehouse import Warehouse
from riskweave.sources.files import csv_wanted


def _merged(spark, path):
    return wide.merge(dataset.wide_left(spark, path), dataset.wide_right(spark, path), "OrderID")


def _engineered(spark, path):
    return wide.engineer(_merged(spark, path)).drop("OrderID")


def _clean(spark, path):
    """The merged rows are written once: coding, pruning and packing each pass
    over them, and must not join again."""
    merged = materialize(_engineered(spark, path), "wide")
    return wide.fill_sentinel(wide.encode_text(merged))


def identity_join(spark, path):
    return _merged(spark, path).select("TransactionID", "R_emaildomain", "DeviceType", "id_01")


def etl_engineered(spark, path):
    out = _engineered(spark, path).select(
        "TransactionID", "hour_of_day", "day_of_week", "log_amount", "email_match", "purchaser_gmail",
        "is_credit", "is_debit", "M1", "M2",
    )
    return rounded(out, "log_amount")


def etl_encoded(spark, path):
    return _clean(spark, path).select("TransactionID", "ProductCD", "card6", "P_emaildomain", "R_emaildomain", "DeviceType", "id_01", "dist1")


def near_constant_columns(spark, path):
    out = wide.variances(_clean(spark, path)).filter(F.col("column") != "TransactionDT")
    # variances span many magnitudes; compare their logarithms
    return out.select("column", F.round(F.log10(F.nullif("variance", F.lit(0.0))), 6).alias("log_variance"), "keep")


def json_packed(spark, path):
    packed = wide.pack(wide.drop_near_constant(_clean(spark, path)))
    return rounded(packed, "log_amount")


def json_unpacked(spark, path):
    packed = wide.pack(wide.drop_near_constant(_clean(spark, path)))
    wanted = ["C1", "D1", "M1", "DeviceType", "id_01", "V999"]
    opened = wide.unpack(packed, wanted)
    return opened.select("TransactionID", *wide.available(opened, [*wanted, "not_there"]))


def load_check(spark, path):
    return rounded(wide.load_check(wide.pack(_clean(spark, path))), "fraud_rate")


def csv_scan(spark, path):
    """The wide file written as CSV, then read by its wanted columns only."""
    out = run_dir(spark, "csv")
    dataset.wide_left(spark, path).write.csv(out, header=True)
    wanted = {"TransactionID": "string", "isFraud": "int", "TransactionAmt": "double", "dist1": "double", "V1": "double", "card6": "string"}
    return csv_wanted(spark, out, wanted)


def wide_load_job(spark, path):
    """The table that the load job leaves after loading everything twice."""
    warehouse = Warehouse(spark, run_dir(spark, "wide-house"))
    for _ in range(2):
        report = jobs.load_wide(warehouse, dataset.wide_left(spark, path), dataset.wide_right(spark, path), "OrderID")
    return rounded(report, "fraud_rate")


def wide_model_roundtrip(spark, path):
    """A model trained on the packed table, which scores every row alike before and after it was saved and loaded."""
    packed = materialize(wide.pack(wide.drop_near_constant(_clean(spark, path))), "packed")
    bundle = models.train_wide(packed, Settings(n_estimators=200, max_depth=5, learning_rate=0.1, scale_pos_weight=5.0))
    folder = run_dir(spark, "bundle-wide")
    models.save(bundle, folder)
    names = ["raw_probability", "decision"]
    before = models.wide_scores(packed, bundle).select(*packed.columns, F.struct(*names).alias("before"))
    after = models.wide_scores(before, models.load(spark, folder))
    return after.select("TransactionID", *[F.col(f"before.{c}").eqNullSafe(F.col(c)).alias(f"same_{c}") for c in names])


QUERIES = {
    "wide_load_job": wide_load_job,
    "wide_model_roundtrip": wide_model_roundtrip,
    "identity_join": identity_join,
    "etl_engineered": etl_engineered,
    "etl_encoded": etl_encoded,
    "near_constant_columns": near_constant_columns,
    "json_packed": json_packed,
    "json_unpacked": json_unpacked,
    "load_check": load_check,
    "csv_scan": csv_scan,
}

_WIDE = """
lft AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS "TransactionID",
         l_orderkey AS "OrderID", CAST(l_returnflag = 'R' AS INTEGER) AS "isFraud",
         date_diff('second', TIMESTAMP '1995-01-01 00:00:00', l_shipdate) AS "TransactionDT",
         l_extendedprice AS "TransactionAmt", 'P' || CAST(l_suppkey % 5 AS VARCHAR) AS "ProductCD",
         CASE l_returnflag WHEN 'A' THEN 'credit' WHEN 'N' THEN 'debit' END AS card6,
         CAST(l_suppkey AS DOUBLE) AS addr1, CASE WHEN l_tax > 0 THEN l_tax * 100 END AS dist1,
         CASE WHEN l_linestatus = 'F' THEN 'gmail.com' ELSE 'mail.com' END AS "P_emaildomain",
         l_quantity AS "C1", l_discount AS "C2", CAST(l_linenumber AS DOUBLE) AS "D1",
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 ELSE -1 END AS "M1",
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS "M2"
  FROM lineitem),
rgt AS (
  SELECT o_orderkey AS "OrderID", CASE WHEN o_orderstatus = 'F' THEN 'gmail.com' ELSE 'mail.com' END AS "R_emaildomain",
         o_orderpriority AS "DeviceType", o_totalprice AS id_01
  FROM orders WHERE o_orderstatus <> 'P'),
merged AS (SELECT * FROM lft LEFT JOIN rgt USING ("OrderID")),
eng AS (
  SELECT *, CAST(("TransactionDT" // 3600) % 24 AS INTEGER) AS hour_of_day, CAST(("TransactionDT" // 86400) % 7 AS INTEGER) AS day_of_week,
         ln(1 + "TransactionAmt") AS log_amount, CAST(coalesce("P_emaildomain" = "R_emaildomain", false) AS INTEGER) AS email_match,
         CAST("P_emaildomain" = 'gmail.com' AS INTEGER) AS purchaser_gmail, CAST(coalesce(card6 = 'credit', false) AS INTEGER) AS is_credit,
         CAST(coalesce(card6 = 'debit', false) AS INTEGER) AS is_debit
  FROM merged),
cln AS (
  SELECT * REPLACE (
    CAST(dense_rank() OVER (ORDER BY "ProductCD") - 1 AS INTEGER) AS "ProductCD",
    CAST(dense_rank() OVER (ORDER BY coalesce(card6, '__NAN__')) - 1 AS INTEGER) AS card6,
    CAST(dense_rank() OVER (ORDER BY "P_emaildomain") - 1 AS INTEGER) AS "P_emaildomain",
    CAST(dense_rank() OVER (ORDER BY coalesce("R_emaildomain", '__NAN__')) - 1 AS INTEGER) AS "R_emaildomain",
    CAST(dense_rank() OVER (ORDER BY coalesce("DeviceType", '__NAN__')) - 1 AS INTEGER) AS "DeviceType",
    coalesce(id_01, -999e0) AS id_01, coalesce(dist1, -999e0) AS dist1)
  FROM eng)"""

_NUMERIC = (
    "TransactionAmt ProductCD card6 addr1 dist1 P_emaildomain C1 C2 D1 M1 M2 R_emaildomain DeviceType id_01 "
    "hour_of_day day_of_week log_amount email_match purchaser_gmail is_credit is_debit"
).split()
_VARIANCES = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", var_samp(CAST(\"{c}\" AS DOUBLE)) AS v FROM cln" for c in _NUMERIC)

SQL = {
    "wide_model_roundtrip": query(_WIDE, 'SELECT "TransactionID", true AS same_raw_probability, true AS same_decision FROM lft'),
    # one row per id, the first one written
    "wide_load_job": query(
        _WIDE,
        """SELECT count(*) AS total, CAST(sum(y) AS BIGINT) AS fraud_count, round(sum(y) / CAST(count(*) AS DOUBLE), 6) AS fraud_rate
        FROM (SELECT arg_min("isFraud", "TransactionDT") AS y FROM lft GROUP BY "TransactionID")""",
    ),
    "identity_join": query(_WIDE, 'SELECT "TransactionID", "R_emaildomain", "DeviceType", id_01 FROM merged'),
    "etl_engineered": query(
        _WIDE,
        """SELECT "TransactionID", hour_of_day, day_of_week, round(log_amount, 6) AS log_amount, email_match, purchaser_gmail,
        is_credit, is_debit, "M1", "M2" FROM eng""",
    ),
    "etl_encoded": query(
        _WIDE, 'SELECT "TransactionID", "ProductCD", card6, "P_emaildomain", "R_emaildomain", "DeviceType", id_01, dist1 FROM cln'
    ),
    "near_constant_columns": query(
        _WIDE, f'SELECT "column", round(log10(nullif(v, 0)), 6) AS log_variance, NOT coalesce(v < 0.001, false) AS keep FROM ({_VARIANCES})'
    ),
    "json_packed": query(
        _WIDE,
        """SELECT "TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", card6, addr1,
        nullif(dist1, -999) AS dist1, "P_emaildomain", "R_emaildomain", day_of_week, round(log_amount, 6) AS log_amount,
        email_match, is_credit,
        CAST(json_object('C1', "C1", 'D1', "D1", 'M1', CAST("M1" AS DOUBLE), 'M2', CAST("M2" AS DOUBLE), 'DeviceType', CAST("DeviceType" AS DOUBLE),
          'id_01', nullif(id_01, -999), 'purchaser_gmail', CAST(purchaser_gmail AS DOUBLE), 'is_debit', CAST(is_debit AS DOUBLE)) AS VARCHAR) AS features_json
        FROM cln""",
    ),
    "json_unpacked": query(
        _WIDE,
        """SELECT "TransactionID", "C1", "D1", CAST("M1" AS DOUBLE) AS "M1", CAST("DeviceType" AS DOUBLE) AS "DeviceType", id_01, -999e0 AS "V999" FROM cln""",
    ),
    "load_check": query(
        _WIDE,
        """SELECT count(*) AS total, CAST(sum("isFraud") AS BIGINT) AS fraud_count,
        round(sum("isFraud") / CAST(count(*) AS DOUBLE), 6) AS fraud_rate FROM cln""",
    ),
    "csv_scan": query(_WIDE, 'SELECT "TransactionID", "isFraud", "TransactionAmt", dist1, card6 FROM lft'),
}
