"""Expression rules: types, names, texts, references, skip lists."""

import pytest
from pyspark.sql import functions as F

from starcard.functions.text import (
    bytes_text, clean_text, fk_parts, fk_table, iso_time, normalize_name, safe_id, tokens, valid_schema,
)
from starcard.functions.types import affinity, spark_type, type_string
from starcard.operators.catalog import is_skipped, user_tables


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given,expected",
    [
        ("NUMBER(15,0)", "INTEGER"), ("NUMBER(10,2)", "REAL"), ("NUMBER(15)", "INTEGER"), ("NUMBER", "REAL"),
        ("VARCHAR2(100)", "TEXT"), ("CHAR(10)", "TEXT"), ("CLOB", "TEXT"), ("LONG", "TEXT"), ("DATE", "TEXT"),
        ("TIMESTAMP(6)", "TEXT"), ("BLOB", "BLOB"), ("LONG RAW", "BLOB"), ("FLOAT", "REAL"),
        ("BINARY_DOUBLE", "REAL"), ("INTEGER", "INTEGER"), ("SMALLINT", "INTEGER"), ("varchar2(100)", "TEXT"),
        ("  VARCHAR2(60)  ", "TEXT"), ("\tnumber(3)\n", "INTEGER"), ("SOME_UNKNOWN_TYPE", "TEXT"),
        ("NUMBER(10,0) X", "INTEGER"), ("NUMBER(10,-2)", "TEXT"), ("NUMBER(*,0)", "TEXT"), ("DECIMAL", "TEXT"),
        ("DECIMAL(8, 2)", "REAL"), ("NUMERIC(8)", "INTEGER"), ("INTERVAL DAY TO SECOND", "INTEGER"),
        ("RAW(16)", "BLOB"), ("", "TEXT"),
    ],
)
def test_affinity(spark, given, expected):
    assert one(spark, affinity(F.col("t")), t=given) == expected


@pytest.mark.parametrize(
    "given,expected",
    [
        ("NUMBER(18,0)", "bigint"), ("NUMBER(19)", "decimal(19,0)"), ("NUMBER(12,2)", "decimal(12,2)"),
        ("NUMBER", "double"), ("DATE", "timestamp"), ("RAW(8)", "binary"), ("CLOB", "string"),
        ("INTEGER", "bigint"),
    ],
)
def test_spark_type(spark, given, expected):
    assert one(spark, spark_type(F.col("t")), t=given) == expected


@pytest.mark.parametrize(
    "row,expected",
    [
        (("VARCHAR2", None, None, 30, 120), "VARCHAR2(30)"), (("VARCHAR2", None, None, 0, 120), "VARCHAR2(120)"),
        (("CHAR", None, None, None, 0), "CHAR"), (("NUMBER", 15, 0, 0, 22), "NUMBER(15,0)"),
        (("NUMBER", 15, None, 0, 22), "NUMBER(15)"), (("NUMBER", None, 2, 0, 22), "NUMBER"),
        (("DATE", None, None, 0, 7), "DATE"), ((None, None, None, None, None), ""),
    ],
)
def test_type_string(spark, row, expected):
    df = spark.createDataFrame([row], "t string, p int, s int, c int, d int")
    got = df.select(type_string(*[F.col(c) for c in "tpscd"]).alias("x")).first()["x"]
    assert got == expected


@pytest.mark.parametrize(
    "given,expected",
    [
        ("PATIENT_SEX_ID", "patient sex"), ("BIRTH_DATE", "birth date"), ("SUBSTANCE_NAME", "substance name"),
        ("RMS_CODE", "rms"), ("START_DATE", "start date"), ("A_ID_CODE", "a id"), ("ID", "id"), ("FLAG_", "flag "),
    ],
)
def test_normalize_name(spark, given, expected):
    assert one(spark, normalize_name(F.col("n")), n=given) == expected


@pytest.mark.parametrize(
    "given,expected",
    [
        (None, None), ("", None), ("  ", None), ("NaN", None), (" nan\n", None), (" a_x000D_b ", "a\nb"),
        ("_x000D_", None), ("\t text \n", "text"), ("nano", "nano"),
    ],
)
def test_clean_text(spark, given, expected):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(clean_text(F.col("t")).alias("x")).first()["x"] == expected


@pytest.mark.parametrize(
    "fk,parts,table",
    [("S.T.C", ("S", "T", "C"), "S.T"), ("S.T", None, None), ("A.B.C.D", None, None), (None, None, None), ("", None, None)],
)
def test_fk_parts(spark, fk, parts, table):
    row = spark.createDataFrame([(fk,)], "f string").select(
        fk_parts(F.col("f")).alias("p"), fk_table(F.col("f")).alias("t")
    ).first()
    assert (tuple(row["p"]) if row["p"] else None) == parts
    assert row["t"] == table


def test_schema_names(spark):
    good = ["ICSR", "ICSR_EMA", "ICSR_LOOKUP", "Schema1", "my_schema", "MySchema123", "A", "a1_b2_c3"]
    bad = ["123invalid", "_invalid", "invalid-name", "", "invalid\nname", "invalid\0name", "invalid.name", "name\n"]
    df = spark.createDataFrame([(n,) for n in good + bad], "n string").filter(valid_schema(F.col("n")))
    assert {r["n"] for r in df.collect()} == set(good)


@pytest.mark.parametrize(
    "name,schema,skipped",
    [
        ("TMP_X", "A", True), ("tmp_x", "A", True), ("DD_SAFETYREPORT_DUPLICATES", "A", False), ("DD_X", "A", True),
        ("X_HIST", "A", False), ("X_HIST", "ICSR_EMA", True), ("X_LOG", "A", True), ("A_BK_1", "A", True),
        ("A_BAK", "A", True), ("CRITERIA", "A", True), ("ACCESS_LEVEL", "A", False),
        ("ACCESS_LEVEL", "ICSR_LOOKUP", True), ("PATIENT", "ICSR", False), ("LOG_X", "A", False),
    ],
)
def test_skip_rules(spark, name, schema, skipped):
    assert one(spark, is_skipped(F.col("n"), F.col("s")), n=name, s=schema) is skipped


def test_system_tables(spark):
    names = ["ZZ", "ZZ_X", "ZZA", "DR$I", "DRX", "BIN$1", "MLOG$_A", "RUPD$_B", "RV$C", "PATIENT"]
    df = spark.createDataFrame([("A", n) for n in names] + [("B", "OTHER")], "owner string, table_name string")
    assert {r["table_name"] for r in user_tables(df, "a").collect()} == {"ZZ", "DRX", "PATIENT"}


def test_small_texts(spark):
    assert one(spark, safe_id(F.col("x")), x="A$B.C/D\\E#F?") == "A_B_C_D_E_F_"
    assert one(spark, tokens(F.col("x")), x="The DRUG_Reaction of Élan 2") == ["drug", "reaction", "élan", "2"]
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05' AS a, timestamp_ntz'2024-01-02 03:04:05.000120' AS b, X'41FF' AS c")
    row = df.select(iso_time(F.col("a")), iso_time(F.col("b")), bytes_text(F.col("c"))).first()
    assert tuple(row) == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.000120", "A�")
