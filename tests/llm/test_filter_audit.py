import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from locspark.llm.filter_audit import audit_filters, default_filters, failures, interactions, joint_failures

SCHEMA = "doc_id long, text string, lang string, words int, digest string, good int"


def corpus(n=60):
    rng = random.Random(3)
    out = []
    for i in range(n):
        words = [rng.choice(["a", "b", "Cc", "é", "word"]) + (str(rng.randrange(40)) if rng.random() < 0.6 else "") for _ in range(rng.choice([0, 3, 150, 199, 200, 230]))]
        text = rng.choice([" ", "\n", "\t\x0b"]).join(words) + rng.choice(["", "", " #", "$ |"])
        out.append((i, text, rng.choice(["en", "de", None, ""])))
    out += [(100, out[5][1], "en"), (101, out[5][1], "de"), (101, out[5][1], "de"), (None, out[5][1], "en"), (None, None, None), (None, None, None), (7, "", "en"), (102, "ABC def " * 5000, "de"), (103, "word " * 199 + "\x00word", "de")]
    return out


def brute(rows, labels):
    least, out = {}, {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        fails = {f for f, x in zip("ABCDE", fails) if x}
        good, toxic = any(a == i and q == 1 for a, q, _ in labels if a is not None), any(a == i and x == 1 for a, _, x in labels if a is not None)
        for p in permutations("ABCDE"):
            first = next((k for k, f in enumerate(p) if f in fails), 5)
            for k, f in enumerate(p):
                own = out.setdefault((lang or "", "".join(p), k + 1), [0] * 6)
                for j, x in enumerate((first > k, first == k, f in fails and first < k, fails == {f}, first == k and good, first == k and toxic)):
                    own[j] += x
    value = {}
    for (part, order, k), x in out.items():
        value[part, order[k - 1]] = value.get((part, order[k - 1]), 0) + x[1]
    return sorted((*at, *x, value[at[0], at[1][at[2] - 1]]) for at, x in out.items())


def test_against_brute_force(spark):
    rows = corpus()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 105, 3)] + [(6, 0, 1), (6, None, None), (None, 1, 1), (101, 1, 0), (101, 0, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", 9) for r in rows], SCHEMA)
    said = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = audit_filters(docs, said)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"] and dict(got.dtypes)["step"] == "int" and {t for c, t in got.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, labels)


def test_other_filters_and_dividends(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "a b", "en"), (3, "#", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = {"x": F.size("words") < 2, "y": "copy"}
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in audit_filters(docs, none, rules).collect()}
    assert got == {("xy", 1): (2, 1, 2), ("xy", 2): (1, 1, 2), ("yx", 1): (2, 1, 2), ("yx", 2): (1, 1, 2)}
    joint = joint_failures(failures(docs, none, rules), list(rules))
    assert {r.filters: (r.n_joint, r.dividend) for r in interactions(joint, list(rules)).collect()} == {"x": (1, 1), "y": (1, 1), "xy": (0, 0)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == [] and len(default_filters()) == 5
