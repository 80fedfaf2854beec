"""Labelled constraint cases: every must-reject row is rejected, no other is."""
import pytest

from vacancia.candidate import Profile
from vacancia.operators.constraints import check_hard_constraints, enforcement

LIMIT = 4
PROFILE = Profile(
    name="t", hard_constraints=(("visa", "any"), ("min_years", str(LIMIT)), ("exclude_pattern", "lead|manager|head of"),
                                ("location_us_only", "true")),
    strong=("python", "scala"), working=("kubernetes",))

GAPS = ("", " ", " " * 8, " " * 9, " " * 30, "<b> </b>" * 6)
ANCHORS = ("experience", "professional", "relevant", "engineering", "coding", "career")


def years_cases():
    """Each requirement form with numbers around the limit, each dash and gaps of any length."""
    for n in (LIMIT - 1, LIMIT, LIMIT + 1):
        fits = n < LIMIT
        for anchor in ANCHORS:
            yield f"{n} years {anchor}", fits
            yield f"{n}+ yrs of mixed {anchor}", fits
        for opening in ("minimum", "at least", "requires"):
            yield f"{opening} {n} years", fits
        yield f"{n}+ years", fits
        yield f"{n} years, in a firm", True
        for gap in GAPS:
            for dash in "-–":
                yield f"{n}{gap}{dash}{gap}{n + 3} years of coding", fits


def language_cases():
    for opening in ("develop {} daily, {} all day", "{} required. write {}"):
        for name, known in (("rust", False), ("scala", True)):
            yield opening.format(name, name), known
    yield "the gopher is our mascot", True


def place_cases():
    for place in ("London", "Berlin", "Toronto", "Tokyo", "EMEA"):
        yield f"office in {place}", False
        yield f"office in {place} or remote in the United States", True
    for place in ("Boston", "Seattle", "remote, US", "Oslo"):
        yield f"office in {place}", True


def title_cases():
    for term in ("lead", "manager", "head of"):
        yield f"{term.title()} things", False
    for area in ("application", "product", "cloud"):
        for role in ("engineer", "architect"):
            yield f"{area} security {role}", False
            yield f"software, {area} security {role}", True
    yield "developer", True


CASES = ([("developer", text, fits) for cases in (years_cases, language_cases, place_cases) for text, fits in cases()]
         + [(title, "text", fits) for title, fits in title_cases()])


@pytest.fixture(scope="module")
def checked(spark):
    df = spark.createDataFrame(CASES, "title string, raw_json string, should_pass boolean")
    return check_hard_constraints(df, PROFILE).cache()


def test_every_case(checked):
    wrong = [(r.title, r.raw_json, r.failures) for r in checked.collect() if r.passed != r.should_pass]
    assert wrong == []


def test_enforcement(checked):
    row = enforcement(checked).first()
    assert (row.enforcement, row.false_positive_rate) == (1.0, 0.0)


def test_messages_are_distinct_and_ordered(spark):
    df = spark.createDataFrame(
        [("Team Lead", "6+ years of coding. 6+ years of coding. Write rust and develop rust")],
        "title string, raw_json string")
    assert check_hard_constraints(df, PROFILE).first().failures == [
        "Requires 6+ years experience (max 3)", 'Title contains excluded term: "lead"',
        "Primary language: rust (not in candidate skills)"]


def test_strict_location_needs_whole_words(spark):
    df = spark.createDataFrame([("Dev", "Indiana office, london team"), ("Dev", "Indiana office")],
                               "title string, raw_json string")
    loose = [r.passed for r in check_hard_constraints(df, PROFILE).collect()]
    strict = [r.passed for r in check_hard_constraints(df, PROFILE, strict=True).collect()]
    assert loose == [False, False] and strict == [False, True]


def test_clearance_only_when_asked(spark):
    df = spark.createDataFrame([("Dev", "active top secret clearance needed")],
                               "title string, raw_json string")
    asked = Profile(name="t", hard_constraints=(("clearance", "none"),))
    assert check_hard_constraints(df, PROFILE).first().passed
    assert check_hard_constraints(df, asked).first().failures == ["Requires security clearance"]
