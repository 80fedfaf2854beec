import hashlib
import random
import re

from tests.llm.conftest import prose
from vacancia.llm.secrets import evidence_threshold, mask_secrets, secret_spans

BASE = [("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]


def brute(text):
    found = []
    for rank, (name, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), rank, m.end(), name) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    found.sort()
    return found, ",".join(f"{n}:{s}:{e}" for s, _, e, n in found)


TRICKY = [
    "token=api_key: abcdefghijklmnop", "token=secret=abcdefghijklmnop", "PassWord = 'short' passwd:\"" + "x" * 12 + '"',
    "🎉é token: " + "ab" * 20 + " end AKIA" + "0" * 14 + "AKIAAKIA", "deadbeefdeadbeef" * 3 + " secret:" + "f" * 11,
    "api_key=" + "0123456789abcdef" + " apikey : " + "0123456789ABCDEF", "ſecret: " + "a" * 20, "hex " * 50 + "a" * 16,
    " ".join(f"{n:016x}" for n in range(600)),
]


def test_base_spans_match_brute_force(spark, awkward):
    texts = [r["text"] for r in awkward.select("text").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY + texts)], "doc_id long, text string")
    for r in secret_spans(df).collect():
        found, listed = brute((TRICKY + texts)[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[1] == k for f in found) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_random_runs_are_found_and_ordinary_ones_are_not(spark):
    rng = random.Random(4)
    code = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = ["".join(rng.choices(code, k=40)) for _ in range(30)]
    plain = ["internationalization_helper_function", "SOME_LONG_CONSTANT_NAME_FOR_TESTS", "1234567890" * 3,
             "path/to/some/very/ordinary/file/name", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 40, "abab" * 10]
    df = spark.createDataFrame([(i, f"here {s} is") for i, s in enumerate(secrets + plain)], "doc_id long, text string")
    found = {r["doc_id"]: r["n_random"] for r in secret_spans(df).collect()}
    assert sum(found[i] for i in range(30)) >= 28
    assert all(found[30 + k] == 0 for k in range(len(plain)))


def test_keys_joined_to_words_are_found_and_masked(spark):
    """Keys in url paths, behind dash-joined words and behind assignments of other names, and hex in dashed groups."""
    rng = random.Random(11)
    code = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def key():
        return "".join(rng.choices(code, k=32))

    def grouped():
        return "-".join("".join(rng.choices("0123456789abcdef", k=n)) for n in (8, 4, 4, 4, 12))
    shapes = [lambda k: f"see https://example.com/some/path/of/{k}", lambda k: f"my-service-account-key-{k}",
              lambda k: f"name_of_the_thing={k}"]
    rows = [shape(key()) for shape in shapes for _ in range(30)] + [f"id {grouped()} here" for _ in range(30)]
    plain = ["this-is-a-long-dashed-heading-of-an-article", "a/very/long/path/internationalization/configuration",
             "2024-01-02-03-04-05-06-07-08", "face-added-decade-facade-beaded-cabbage", "SOME-CONSTANT_NAME/WITH=PARTS",
             "tel-0123-4567-8901-2345-6789"] * 5
    df = spark.createDataFrame(list(enumerate(rows + plain)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in secret_spans(df).collect()}
    for k in range(4):
        assert sum(found[i]["n_random"] > 0 for i in range(30 * k, 30 * k + 30)) >= 28, k
    assert all(found[len(rows) + i]["n_random"] == 0 for i in range(len(plain)))
    texts = {r["doc_id"]: r["text"] for r in mask_secrets(df).collect()}
    for i, text in enumerate(rows):
        if found[i]["n_random"]:
            assert "[SECRET]" in texts[i] and re.split(r"[ /=-]", text)[-1 if i < 90 else 1] not in texts[i]


def test_a_short_run_needs_more_evidence_among_many_candidates(spark):
    rng = random.Random(5)
    token = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=20))
    few = spark.createDataFrame([(0, token)], "doc_id long, text string")
    many = spark.createDataFrame([(0, token)] + [(k, prose(k, 3).replace(" ", "") * 5) for k in range(1, 800)],
                                 "doc_id long, text string")
    assert evidence_threshold(few) < evidence_threshold(many)


def test_masking(spark, awkward, nothing):
    df = spark.createDataFrame([(1, "é🎉 token: " + "ab" * 20 + " tail " + "AKIA" + "Z" * 16), (2, None), (3, "clean")],
                               "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in mask_secrets(df).collect()}
    assert got == {1: "é🎉 [SECRET] tail [SECRET]", 2: None, 3: "clean"}
    out = mask_secrets(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert out.filter("text is null").count() == awkward.filter("text is null").count()
    assert mask_secrets(nothing).count() == 0 and secret_spans(nothing).count() == 0
