import itertools
import random
import re

from freshet.llm import filter_audit as fa


def test_audit_equals_filters_applied_one_by_one(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in [*range(120), None, None]:
        text = draw.choice([None, "", " ".join(draw.choices(words[:40], k=80)), " ".join(draw.choices(words, k=60)), "AB " * 60, "x # y", " ".join(draw.choices(words, k=55)) + " É|", "same text again"])
        docs.append((i, text, draw.choice(["s1", "s2", None, ""])))
        if i is not None and i % 2:
            labels += [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None]))] * draw.choice([1, 2])
    docs += docs[:5]
    labels.append((10**6, 1, 1))

    def fails(doc, f):
        doc_id, text = doc[0], doc[1] or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        if f == "E":
            return doc_id is not None and any(d[0] is not None and d[0] < doc_id and (d[1] or "") == text for d in docs)
        return {"A": len(found) < 50, "B": 100 * len(set(found)) < 65 * len(found), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}[f]

    failed = [{f for f in "ABCDE" if fails(d, f)} for d in docs]
    good = {x for x, q, _ in labels if q == 1}
    toxic = {x for x, _, t in labels if t == 1}
    want, removals = {}, {}
    for part in {d[2] or "" for d in docs}:
        for order in itertools.permutations("ABCDE"):
            alive = [i for i, d in enumerate(docs) if (d[2] or "") == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [i for i in alive if f in failed[i]]
                redundant = sum(f in failed[i] for i in gone)
                alive = [i for i in alive if i not in hit]
                gone += hit
                alone = sum(failed[i] == {f} for i, d in enumerate(docs) if (d[2] or "") == part)
                want[part, "".join(order), step] = [len(alive), len(hit), redundant, alone, sum(docs[i][0] in good for i in hit), sum(docs[i][0] in toxic for i in hit)]
                removals[part, f] = removals.get((part, f), 0) + len(hit)
    tables = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumnRenamed("source", "source"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = fa.audit(tables[0].selectExpr("*", "1 as mask", "'z' as part", "2 as t"), tables[1].selectExpr("*", "3 as good")).collect()
    assert len(got) == len(want)
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        assert list(r[3:9]) == want[key], key
        assert r["shapley"] == removals[r["part"], r["filter_order"][r["step"] - 1]]
    assert fa.audit(tables[0].where("1 = 0"), tables[1]).collect() == []


def test_outcomes_part_the_documents():
    m = fa.outcome_matrices()
    total = m["kept"] + m["removed"]
    # what is neither kept nor removed here was removed before
    assert (total[:, ::5] == 1).all() and (m["redundant"] * m["removed"] == 0).all()
    assert m["kept"].shape == (32, 600)
