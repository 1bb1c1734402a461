import pytest

from freshet.llm import language_id, mixing, packing, secret_scan, sharding, simhash, spotsigs, token_files, toxicity


def _files(docs):
    import public_tokenizers

    return token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


MODEL = toxicity.calibrate(["vile words here"] * 3 + ["vile other words"], ["nice words here", "quite other words"])
OPERATORS = {
    "packing": packing.best_fit, "language": language_id.held_out_language, "simhash": simhash.near_copies, "toxicity": lambda d: toxicity.score(d, MODEL), "files": _files,
    "spotsigs": spotsigs.fingerprint_edits, "sharding": sharding.assign, "mixing": mixing.mix_sizes, "secrets": secret_scan.digest, "keep": simhash.keep_one,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_beyond_two_to_the_53_stay_beside_a_null(spark, name):
    rows = [(2**60 + 1, "first text of all", "en", "a"), (2**60 + 3, "other words stand here", "en", "a"), (None, "a text without an id", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    got = OPERATORS[name](docs).collect()
    assert {r["doc_id"] for r in got} == {2**60 + 1, 2**60 + 3, None}
    if name == "simhash":
        assert {r["component_id"] for r in got} == {2**60 + 1, 2**60 + 3, None}
