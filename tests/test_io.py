"""Raw CSV loading and mart reads."""

from __future__ import annotations

import pytest

from shopsight.sources import io


def test_csv_with_quoted_newline(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"line one\nline two",2020-01-01 00:00:00,2020-01-02 10:00:00\n'
        'r2,o2,3,"ok",,2020-01-03 00:00:00,\n'
    )
    df = io.load_csv(spark, str(path), "order_reviews")
    rows = {r["review_id"]: r for r in df.collect()}
    assert rows["r1"]["review_comment_message"] == "line one\nline two"
    assert rows["r2"]["review_score"] == 3 and rows["r2"]["review_answer_timestamp"] is None


def test_bad_record_fails_fast(spark, tmp_path):
    path = tmp_path / "payments.csv"
    path.write_text("order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,x,boleto,1,10.0\n")
    with pytest.raises(Exception):
        io.load_csv(spark, str(path), "order_payments").collect()


def test_missing_files_are_skipped(spark, tmp_path):
    (tmp_path / "sellers.csv").write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,1,a,sp\n")
    got = io.load_raw_csv(spark, str(tmp_path))
    assert list(got) == ["sellers"]


def test_read_mart_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        io.read_mart(spark, "x", str(tmp_path), source="warehouse")
    with pytest.raises(FileNotFoundError):
        io.read_mart(spark, "missing", str(tmp_path))


def test_write_table_counts_rows(spark, tmp_path):
    df = spark.range(42)
    assert io.write_table(df, str(tmp_path / "t")) == 42
    assert io.read_mart(spark, "t", str(tmp_path)).count() == 42


PAYMENTS = "order_id,payment_sequential,payment_type,payment_installments,payment_value"


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "payments.csv"
    path.write_text("payment_value,order_id,payment_installments,payment_sequential,payment_type\n10.119,o1,7,3,boleto\n")
    row = io.load_csv(spark, str(path), "order_payments").first()
    assert (row["order_id"], row["payment_sequential"], row["payment_installments"], row["payment_type"]) == ("o1", 3, 7, "boleto")
    assert str(row["payment_value"]).rstrip("0") == "10.119"  # every digit is kept


@pytest.mark.parametrize("header", [PAYMENTS.replace("payment_type,", ""), PAYMENTS + ",extra", PAYMENTS.replace("payment_type", "order_id")])
def test_wrong_columns_are_refused(spark, tmp_path, header):
    path = tmp_path / "payments.csv"
    path.write_text(header + "\n" + ",".join("1" for _ in header.split(",")) + "\n")
    with pytest.raises(ValueError):
        io.load_csv(spark, str(path), "order_payments")


def test_files_with_different_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "payments.csv"
    folder.mkdir()
    (folder / "a.csv").write_text(PAYMENTS + "\no1,1,boleto,1,10.0\n")
    (folder / "b.csv").write_text("payment_sequential,order_id,payment_type,payment_installments,payment_value\n1,o2,boleto,1,10.0\n")
    with pytest.raises(Exception):
        io.write_table(io.load_csv(spark, str(folder), "order_payments"), str(tmp_path / "out"))


def test_bad_record_fails_the_stored_count(spark, tmp_path):
    path = tmp_path / "payments.csv"
    path.write_text(PAYMENTS + "\no1,x,boleto,1,10.0\n")
    with pytest.raises(Exception):
        io.write_table(io.load_csv(spark, str(path), "order_payments"), str(tmp_path / "out"))


def test_csv_without_free_text_is_split(spark, tmp_path):
    path = tmp_path / "payments.csv"
    path.write_text(PAYMENTS + "\n" + "".join(f"o{i},1,boleto,1,{i}.5\n" for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
    try:
        df = io.load_csv(spark, str(path), "order_payments")
        assert df.rdd.getNumPartitions() > 2 and df.count() == 60_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_warehouse_from_csv(spark, tmp_path):
    """Nine CSV files to eight marts, with the rows that the test tables give."""
    from helpers import SF_SMALL
    from pyspark.sql import functions as F
    from shopsight.plans.warehouse import Warehouse, build
    from shopsight.sources.schemas import RAW_SCHEMAS

    bound = Warehouse.from_test_tables(spark, SF_SMALL)
    for name, schema in RAW_SCHEMAS.items():
        typed = bound.raw[name].select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        io.write_csv(typed, str(tmp_path / "csv" / f"{name}.csv"))
    loaded = Warehouse.from_csv(spark, str(tmp_path / "csv"), str(tmp_path / "raw"))
    assert build(loaded, str(tmp_path / "marts")) == build(bound, str(tmp_path / "bound"))
    both = [spark.read.parquet(str(tmp_path / d / "monthly_revenue")) for d in ("marts", "bound")]
    assert both[0].exceptAll(both[1]).isEmpty() and both[1].exceptAll(both[0]).isEmpty()
