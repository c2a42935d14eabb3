import pytest

from evidentia.operators import packed

FIELDS = ["subject", "author"]
SCHEMA = "row_id bigint, subject string, author string, pos int"


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def column(spark):
    """Enough plain cells to learn from, then the hard ones."""
    people = ["Ann Lee", "Bo Kim", "Cy Day", "Lee, Ann", "Day, Cy", "D. Roe", "Roe, D."]
    plain = [(i, f"(AB) One;(CD) Two, Too;{'(EF) X - Y;' if i % 2 else ''}", f"{people[i % 7]};{people[(i + 2) % 7]};", 0) for i in range(60)]
    hard = [
        (100, '"(CD) Two, Too" ; (AB) One', "Ann Lee, Bo Kim and D. Roe", 1),
        (101, '["(AB) One", "(EF) X - Y"]', '"Lee, Ann"', 1),
        (102, None, "", 1),
        (103, ";", " ; ;", 1),
        (104, '"say ""so""; twice";(AB) One', "Day, Cy|Bo Kim\nLee, Ann", 1),
        (104, '"say ""so""; twice";(AB) One', "Day, Cy|Bo Kim\nLee, Ann", 1),
    ]
    got = packed.unpack(_rows(spark, plain + hard), "row_id", FIELDS).collect()
    out = {}
    for r in got:
        out.setdefault((r["row_id"], r["field_name"]), []).append((r["pos"], r["item"]))
    return {k: [x for _, x in sorted(v)] for k, v in out.items()}


def test_quotes_and_json(column):
    assert column[100, "subject"] == ["(CD) Two, Too", "(AB) One"]
    assert column[101, "subject"] == ["(AB) One", "(EF) X - Y"]
    assert column[101, "author"] == ["Lee, Ann"]


def test_learned_commas(column):
    assert column[0, "subject"][1] == "(CD) Two, Too"
    assert column[100, "author"] == ["Ann Lee", "Bo Kim", "D. Roe"]


def test_empty_cells_give_nothing(column):
    assert not [k for k in column if k[0] in (102, 103)]


def test_repeated_rows_and_mixed_signs(column):
    assert sorted(column[104, "author"]) == sorted(2 * ["Day, Cy", "Bo Kim", "Lee, Ann"])
    assert column[104, "subject"].count('say "so"; twice') == 2


def test_empty_table(spark):
    assert packed.unpack(_rows(spark, []), "row_id", FIELDS).count() == 0


def test_very_long_cell(spark):
    cell = ";".join(f"(AB) N{i}" for i in range(3000))
    got = packed.unpack(_rows(spark, [(1, cell, None, 0)]), "row_id", ["subject"])
    assert got.count() == 3000


def test_values_of_many_atoms(spark):
    long = "Dept of A, B, C, D, E, F, G, H, I, J, K and L"
    rows = [(i, f"{long}; Centre {i}") for i in range(8)] + [(9, long)]
    got = packed.unpack(spark.createDataFrame(rows, "row_id bigint, cell string"), "row_id", ["cell"]).collect()
    assert [r["item"] for r in got if r["row_id"] == 9] == [long]
