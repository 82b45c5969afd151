"""Fences of the quality rules: rare characters, languages of few documents, joins of the fences."""

import random

import public_tokenizers as P
from cases import by_id

from siltworks.llm import quality_rules as rules

VOCABULARIES = (P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
ENGLISH = "river house the of morning light and walked toward small garden where children played until evening".split()
GREEK = "το ποτάμι και σπίτι του πρωί φως περπάτησε προς μικρός κήπος όπου παιδιά έπαιζαν μέχρι βράδυ".split()
VIETNAMESE = "dòng sông và ngôi nhà của buổi sáng ánh đi bộ về phía khu vườn nhỏ nơi những đứa trẻ chơi đến tối".split()
SCHEMA = "doc_id long, text string, lang string"


def texts(words, first, n, lang, more=""):
    rng = random.Random(first)
    return [(first + i, " ".join(rng.choices(words, k=rng.randrange(60, 400))) + more, lang) for i in range(n)]


def kept(spark, rows):
    return {i: r["kept"] for i, r in by_id(rules.quality_rules(spark.createDataFrame(rows, SCHEMA), *VOCABULARIES)).items()}


def test_prose_may_hold_rare_characters(spark):
    rows = texts(ENGLISH, 0, 300, "en") + texts(ENGLISH, 1000, 10, "en", " ☕") + texts(ENGLISH, 2000, 10, "en", " 🦀") + texts(ENGLISH, 3000, 10, "en", " ☕ 🦀")
    found = kept(spark, rows)
    assert all(found[i] for i in found if i >= 1000)


def test_languages_of_few_documents_are_not_judged_by_others(spark):
    rows = texts(ENGLISH, 0, 300, "en") + texts(VIETNAMESE, 1000, 6, "vi") + texts(GREEK, 2000, 1, "el") + texts(GREEK, 3000, 5, None)
    found = kept(spark, rows)
    assert all(found[i] for i in found if i >= 1000)


def test_scripts_are_not_shuffled_and_rare_languages_get_the_same_verdicts(spark, monkeypatch):
    rows = texts(ENGLISH, 0, 120, "en") + texts(VIETNAMESE, 1000, 30, "vi") + texts(GREEK, 2000, 5, None)
    rows += [(4000 + i, " ".join("".join(random.Random(100 * i + k).choices("#%$&@!x7Q", k=6)) for k in range(120)), "en") for i in range(5)]
    docs = spark.createDataFrame([*rows, (5000, None, "xx"), (None, "short", None)], SCHEMA)
    found = rules.quality_rules(docs, *VOCABULARIES)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the fences were large
    try:
        plan = rules.quality_rules(docs, *VOCABULARIES)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    shuffled = [line for line in plan.split("\n") if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    assert len(shuffled) == 1 and "by_rare_key" in shuffled[0]
    frequent = sorted((str(r.doc_id), r.kept) for r in found.collect())
    monkeypatch.setattr(rules, "FREQUENT", 2)  # "vi" has under half of the documents
    assert sorted((str(r.doc_id), r.kept) for r in rules.quality_rules(docs, *VOCABULARIES).collect()) == frequent
    assert len(frequent) == len(rows) + 2
