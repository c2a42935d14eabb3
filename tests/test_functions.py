import pytest
from pyspark.sql import functions as F

from evidentia.functions import metadata as M
from evidentia.functions import replies as R
from evidentia.functions import text as T
from evidentia.functions.doi import canonical_doi


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [("X's Y", "Xs Y"), ("the dogs' bowl", "the dogs bowl"), ("'s start", "start"), ("a 's b", "a b"), ("plain", "plain"), ("say 'so", "say so")])
def test_possessives(spark, given, wanted):
    assert one(spark, T.clean_possessives("a"), a=given) == wanted


def test_parentheses_inner_first(spark):
    assert one(spark, T.nested_parentheses("a"), a="x (a (b) c) d") == ["(b)", "(a (b) c)"]


def test_citation_ids_keep_order(spark):
    assert one(spark, T.citation_ids("a"), a="(pqac-aaaa1111, pqac-bbbb2222) pqac-aaaa1111 pqac-no") == ["pqac-aaaa1111", "pqac-bbbb2222"]


@pytest.mark.parametrize(("given", "wanted"), [("Score: 8", 8), ("score is 80", 8), ("fine (7/10)", 7), ("9/10", 9), ("all good 5", 5), ("n/a", 0), ("This is not relevant", 0), ("none at all", None)])
def test_score(spark, given, wanted):
    assert one(spark, R.score_of("a"), a=given) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ('{"summary": "a", "relevance_score": 8}', {"summary": "a", "relevance_score": 8}),
        ('```json\n{"summary": "a\nb", "relevance_score": "3/5"}\n```', {"summary": "a\nb", "relevance_score": 6}),
        ("<think>x</think>just words", {"summary": "just words"}),
        ('{"summary": "a" "Relevance Score": 7.6,}', {"summary": "a", "relevance_score": 8}),
        ('well {"summary": "he said "no" twice", "relevance_score": "4"} end', {"summary": 'he said "no" twice', "relevance_score": 4}),
        ("{broken", None),
    ],
)
def test_reply(given, wanted):
    assert R.parse_reply(given) == wanted


@pytest.mark.parametrize("given", ["10.1234/AB c", "https://doi.org/10.1234/abc", "http://dx.doi.org/10.1234/abc", "doi:10.1234/ABC", " DOI: 10.1234/abc ", "https://www.doi.org/10.1234%2fabc"])
def test_canonical_doi(spark, given):
    assert one(spark, canonical_doi("a"), a=given) == "10.1234/abc"


def test_dates(spark):
    for given in ("2023-01-31T14:30:00+00:00", "2023-01-31 14:30:00", "January 31, 2023", "Jan 31, 2023", "2023-01-31"):
        assert one(spark, F.date_format(M.parse_date("a"), "yyyy-MM-dd"), a=given) == "2023-01-31"
    assert one(spark, M.parse_date("a"), a="31/01/2023") is None


def test_quality_wording(spark):
    c = M.formatted_citation(F.col("a"), F.lit("d"), F.lit(False), F.lit(3), F.lit(0))
    assert one(spark, c, a="C.").endswith("from a poor quality or predatory journal.")


def test_template_needs_values():
    with pytest.raises(ValueError):
        T.fill_template("{x}", {})
