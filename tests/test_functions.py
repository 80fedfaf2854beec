"""Column functions on literal rows, including the regex dialect cases."""
from pyspark.sql import functions as F

from vacancia import rules
from vacancia.candidate import Profile, expand_query
from vacancia.functions import scoring, text, urls
from vacancia.operators import constraints


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "x string").select(*cols).first()


def test_board_urls(spark):
    cases = {
        "https://boards.greenhouse.io/Acme/jobs/1": ("greenhouse", "acme"),
        "see https://jobs.lever.co/two-words/abc": ("lever", "two-words"),
        "https://jobs.ashbyhq.com/x_y": ("ashby", "x_y"),
        "https://apply.workable.com/Firm/j/9": ("workable", "firm"),
        "http://firm.workable.com/jobs/1": ("workable", "firm"),
        "https://apply.workable.com": None, "https://www.workable.com/x": None,
        "https://example.com/careers": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r.u: (r.b.ats_type, r.b.slug) if r.b else None
           for r in df.select("u", urls.parse_board_url(F.col("u")).alias("b")).collect()}
    assert got == cases


def test_request_encoding(spark):
    row = one(spark, "a b", urls.board_fetch_url(F.lit("greenhouse"), F.col("x")).alias("u"))
    assert row.u.endswith("/boards/a%20b/jobs?content=true")


def test_url_variants_strip_trailing_punctuation(spark):
    row = one(spark, "(https://jobs.lever.co/acme). next", urls.extract_urls(F.col("x"), "text").alias("t"),
              urls.extract_urls(F.col("x"), "list").alias("l"))
    assert row.t == ["https://jobs.lever.co/acme"] and row.l == ["https://jobs.lever.co/acme"]


def test_tokenize(spark):
    row = one(spark, "<b>C++</b> and .NET, Über node.js a CI/CD", text.tokenize(F.col("x")).alias("t"))
    assert row.t == ["c++", "and", ".net", "ber", "node.js", "ci/cd"]
    assert text.tokenize_literal("full_stack Node.js") == ["full", "stack", "node.js"]


def test_years_ranges_are_not_read_as_single_years(spark):
    cases = {
        "3-5 years of x": [], "10+ years": [10], "0-3 years experience": [0],
        "minimum 4 years": [4], "at least 6 yrs of software": [6, 6], "50 years of tradition": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r.x: r.y for r in df.select("x", F.concat(
        F.transform(constraints._range_bounds(F.col("x")), lambda r: r["lo"]),
        constraints._single_years(F.col("x"))).alias("y")).collect()}
    assert got == cases


def test_word_edges_are_ascii(spark):
    # A letter outside ASCII counts as an edge, whatever the Java version does.
    pattern = rules.ascii_words(r"\bla\b")
    assert one(spark, "éla é", F.col("x").rlike(pattern).alias("m")).m
    assert not one(spark, "xla", F.col("x").rlike(pattern).alias("m")).m


def test_balanced_array(spark):
    cases = {
        'see [1] ```json\n[{"a":"]["}]\n``` end ]': '[{"a":"]["}]',
        'x [{"a": "q\\" ]"}] y': '[{"a": "q\\" ]"}]',
        "no array": None, "[1, 2] only numbers": None, '[[{"a":1}],2] t': '[[{"a":1}],2]',
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r.x: r.y for r in df.select("x", text.balanced_array(F.col("x")).alias("y")).collect()}
    assert got == cases


def test_description_orders(spark):
    raw = '{"content":"c","descriptionHtml":"","description":"d"}'
    row = one(spark, raw, text.description(F.col("x")).alias("r"),
              text.description(F.col("x"), text.PROMPT_FIELDS).alias("p"))
    assert (row.r, row.p) == ("c", "d")


def test_two_push_thresholds(spark):
    df = spark.createDataFrame([(s,) for s in (39.0, 40.0, 64.9, 65.0, 69.0, 70.0)], "s double")
    rows = df.select(scoring.band(F.col("s")).alias("b"), scoring.tier(F.col("s")).alias("t")).collect()
    assert [r.b for r in rows] == ["skip", "digest", "digest", "push", "push", "push"]
    assert [r.t for r in rows] == ["skip", "digest", "digest", "digest", "digest", "push"]


def test_vendor_times(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05-04:00",), ("2024-01-02",), ("soon",)], "x string")
    got = [r.t for r in df.select(F.unix_millis(text.parse_vendor_time(F.col("x"))).alias("t")).collect()]
    assert got == [1704179045000, 1704153600000, None]


def test_expand_query_is_distinct():
    p = Profile(name="n", role_targets=("backend", "ai_ml"), strong=("Node.js",), working=("java",))
    terms = expand_query(p)
    assert terms[:4] == ["backend", "ai", "ml", "node.js"] and len(terms) == len(set(terms))
    assert set(rules.QUERY_EXPANSION) <= set(terms)


def _scans(text):
    """Every bracket tried in turn: what the one-pass extraction must equal."""
    import re
    bare = re.sub(r"```(?:json)?\s*", "", text)
    token = re.compile(r'"(?:\\.|[^"\\])*"|\[|\]', re.S)
    for start in [i for i, c in enumerate(bare) if c == "["]:
        depth = 0
        for m in token.finditer(bare, start):
            depth += {"[": 1, "]": -1}.get(m.group(), 0)
            if depth == 0 and m.group() == "]":
                if "{" in bare[start:m.end()]:
                    return bare[start:m.end()]
                break
    return None


def test_balanced_extraction_is_that_of_every_bracket_in_turn():
    import random

    from vacancia.functions.text import _outer_array
    rng = random.Random(7)
    for k in range(30_000):
        chars = '[]"\\{}a' if k % 2 else '[[]]""{,` \n'
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 24)))
        assert _outer_array(text) == _scans(text), text


def test_balanced_extraction_is_linear():
    import time

    from vacancia.functions.text import _outer_array
    started = time.perf_counter()
    assert _outer_array("[" * 100_000) is None
    assert _outer_array('["' * 50_000 + "{") is None
    assert _outer_array("[" * 50_000 + "{" + "]" * 50_000)[0] == "["
    assert _outer_array("[]" * 50_000 + "{") is None
    assert time.perf_counter() - started < 2
