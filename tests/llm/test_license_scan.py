import math
import random
import re

from locspark.llm.license_scan import BASE, LEAST, TEMPLATES, scan_licenses


def base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def texts():
    r = random.Random(4)
    words = ["cc", "by", "CC-BY", "general", "Public", "license", "all", "rights", "reserved", ",", "é", "the", "\n", "x1", "by cc"]
    out = [None, "", "...", "cc by cc by cc", "cc\x00by", "ccby", "cc by" * 3, "All  rights\nreserved. " * 3, "é" * 9000]
    return out + [r.choice([" ", "", "-"]).join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(300)]


def test_base_counts(spark):
    data = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "q") for i, t in data], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    for i, t in data:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_labels_of_the_method(spark):
    notices = {
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "All rights reserved.": "reserved", "the mit and the license": "", "licensed under the": "",
    }
    rows = [(i, "word " * 40 + n + " word" * 9) for i, n in enumerate(notices)] + [(100 + i, "some other words") for i in range(20)]
    got = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(notices))] == list(notices.values())


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_brute_force(data):
    """Labels and score of each text: every template at every place of every text."""
    words = {i: cut(t) for i, t in data}
    vocabulary = {w for t in TEMPLATES for w in t.words} | {w for p, _ in BASE for w in p.split()}
    weight = {w: math.log((1 + len(data)) / (1 + sum(w in set(x) for x in words.values()))) + 1e-6 for w in vocabulary}
    out = {}
    for i, own in words.items():
        labels, score = {label for p, label in BASE for k in range(len(own)) if own[k : k + len(p.split())] == p.split()}, 0.0
        score = 1.0 if labels else 0.0
        for t in TEMPLATES:
            for start in range(-len(t.words), len(own)):
                stands = [0 <= start + k < len(own) and own[start + k] == w for k, w in enumerate(t.words)]
                if any(all(stands[a:z]) for a, z in t.keys):
                    share = sum(weight[w] for w, x in zip(t.words, stands) if x) / sum(weight[w] for w in t.words)
                    score = max(score, share)
                    if share >= LEAST:
                        labels.add(t.label)
        out[i] = ",".join(sorted(labels)), min(1.0, round(score, 6))
    return out


def test_labels_and_score_against_brute_force(spark):
    r = random.Random(6)
    data = [(i, None if i == 0 else "") for i in range(2)]
    for i in range(2, 120):
        own = []
        for _ in range(r.randint(0, 3)):
            t = list(r.choice(TEMPLATES).words)
            for _ in range(r.choice([0, 0, 1, 3, len(t) // 20, len(t) // 3])):
                t[r.randrange(len(t))] = r.choice(["other", "the", "software", "license"])
            t = t[r.choice([0, 0, 2]) :]
            own += [r.choice(["some", "word", "the", "of", "use", "cc"]) for _ in range(r.randint(0, 9))] + t
        data.append((i, " ".join(own)))
    got = {x.doc_id: (x.labels, x.score) for x in scan_licenses(spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, score string, word int")).collect()}
    want = by_brute_force(data)
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-6 for i in want)
    assert len({x for x, _ in want.values()}) > 10


def test_every_licence_in_its_own_text_with_changed_words(spark):
    r, rows = random.Random(2), []
    for k, t in enumerate(TEMPLATES):
        words, keep = list(t.words), {i for i in range(*t.keys[0])}
        free = [i for i in range(len(words)) if i not in keep]
        for i in r.sample(free, min(len(free), len(words) // 20)):
            words[i] = "changed"
        rows.append((k, "before it " + " ".join(words) + " after it"))
    rows += [(100 + i, "plain text without any") for i in range(50)]
    got = {x.doc_id: x.labels.split(",") for x in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(t.label in got[k] for k, t in enumerate(TEMPLATES))


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
