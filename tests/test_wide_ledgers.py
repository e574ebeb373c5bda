"""The registered ledger queries on more rows than ids of 16 bits can tell apart, against their SQL."""

import duckdb
import pytest

from huelake.plans import queries as plans
from huelake.sources import ledger as led

ROWS = 70_000


def parts(spark, path, low, high):
    rows = spark.range(low, high, 1, 3).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "concat('Brand#', id % 5) AS p_brand", "concat('TYPE ', id % 3) AS p_type", "cast(id % 50 as int) AS p_size")
    rows.write.parquet(f"{path}/part.parquet")
    return str(path)


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    return parts(spark, tmp_path_factory.mktemp("wide"), 0, ROWS)


def check(spark, folder, name):
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
        want = con.sql(plans.ORACLES[name])
        columns, rows = want.columns, want.fetchall()
    made = plans.QUERIES[name](spark, folder)
    assert made.columns == columns
    assert sorted(map(tuple, made.collect())) == sorted(rows)
    return len(rows)


def test_resolve(spark, wide):
    assert check(spark, wide, "ledger_resolve") == ROWS


def test_sink(spark, wide):
    assert check(spark, wide, "ledger_sink") == ROWS


def test_sink_writes_the_same_bytes_in_pieces(spark, wide, tmp_path):
    path, ledger = str(tmp_path / "ids.csv"), plans.fx.ledger(spark, wide)
    with pytest.raises(ValueError, match="65535"):
        led.ledger_sink(ledger, path)
    led.ledger_sink(ledger, path, plans.WIDE)
    assert open(path, newline="").read() == led.to_text(map(tuple, ledger.collect()))


def test_scan(spark, wide):
    assert check(spark, wide, "ledger_scan") == ROWS


def test_update(spark, wide):
    assert check(spark, wide, "ledger_update") == ROWS + 50


def test_new_names_are_numbered_in_palette_order_over_many_steps(spark):
    names = spark.range(0, 3000, 1, 5).selectExpr("id * 977 - 200000 AS palette_idx", "concat('new ', id) AS name")
    made = led.resolve(names, spark.createDataFrame([(7, "new 2999", False)], led.SCHEMA)).orderBy("palette_idx").collect()
    assert [r.id for r in made] == [*range(8, 8 + 2999), 7]


def test_palette(spark, wide):
    assert check(spark, wide, "palette_build") == 949


@pytest.mark.parametrize(("low", "high"), [(0, 300), (65_500, 65_600), (1_048_550, 1_048_601)])
def test_fingerprint_around_ids_that_need_more_digits(spark, tmp_path, low, high):
    assert check(spark, parts(spark, tmp_path, low, high), "assignment_fingerprint") == 1


def test_fingerprint_of_many_rows(spark, wide):
    with duckdb.connect() as con:  # the digits as in the SQL, whose fold takes too long here
        con.sql(f"CREATE VIEW part AS SELECT * FROM '{wide}/part.parquet/*.parquet'")
        digits = con.sql(plans._BYTES.strip("()")).fetchall()[0][0]
    value = 14695981039346656037
    for i in range(0, len(digits) - 1, 2):
        value = ((value ^ int(digits[i : i + 2], 16)) * 1099511628211) % 2**64
    assert plans.QUERIES["assignment_fingerprint"](spark, wide).first()[0] == f"0x{value:016x}"
