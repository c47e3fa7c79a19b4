import math
import random
import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from cadenza.llm import quality_rules as qr
from tests.llm import cases


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def bins(text):
    left, found = text or "", []
    for pattern in qr.CLASSES.values():
        rest = regex.sub(pattern, "", left)
        found.append(len(left) - len(rest))
        left = rest
    return [*found, len(left)]


def distance(p, q):
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(total / 2, 0))


def plain(rows, most):
    classes, words = {}, {}
    for _, text, lang, *_ in rows:
        classes[lang] = [a + b for a, b in zip(classes.get(lang, [0] * 7), bins(text))]
        words.setdefault(lang, Counter()).update(re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower()))
    out = []
    for doc_id, text, lang, *_ in rows:
        own, all_ = bins(text), classes[lang]
        by_class = distance([x / sum(own) for x in own], [x / sum(all_) for x in all_]) if sum(own) else None
        mine = Counter(re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower()))
        common = [w for w, _ in sorted(words[lang].items(), key=lambda x: (-x[1], x[0].encode()))[:most]]
        total, n = sum(words[lang].values()), sum(mine.values())
        p, q = [mine[w] / n if n else 0 for w in common], [words[lang][w] / total for w in common]
        by_word = distance([*p, 1 - sum(p)], [*q, max(0.0, 1 - sum(q))]) if n else None
        rounded = lambda d: None if d is None else round(d, 5) + 0.0
        out.append((doc_id, *counts(text), rounded(by_class), rounded(by_word)))
    return sorted(out, key=repr)


def found(spark, rows, most, **limits):
    judged = qr.judge(cases.frame(spark, rows), common=most, **limits)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    shown = judged.select("doc_id", *names, F.round("class_distance", 5) + 0.0, F.round("word_distance", 5) + 0.0)
    return sorted((tuple(r) for r in shown.collect()), key=repr)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:7] == y[:7]
        for u, v in zip(x[7:], y[7:]):
            assert (u is None) == (v is None) and (u is None or abs(u - v) < 1e-3), (x, y)


def test_awkward_documents(spark):
    rows = cases.documents()
    close(found(spark, rows, 5), plain(rows, 5))


def test_repeated_windows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, "\n".join(rng.choice(["a b", "", " \t", "c", "a b "]) for _ in range(12)), "en", "s", 0) for i in range(20)]
    close(found(spark, rows, 2), plain(rows, 2))


def test_documents_unlike_their_language_are_rejected(spark):
    rng = random.Random(6)
    good = [(i, cases.sentence(rng, 150), "en", "s", 0) for i in range(50)]
    odd = [(100, " ".join(f"{rng.random()}" for _ in range(150)), "en", "s", 0), (101, " ".join(f"w{i}q" for i in range(150)), "en", "s", 0)]
    kept = {r.doc_id: r.kept for r in qr.judge(cases.frame(spark, good + odd)).collect()}
    assert [d for d, k in kept.items() if not k and d < 100] == []
    assert not kept[100] and not kept[101]


def test_a_large_reference_is_joined_in_parts(spark, monkeypatch):
    from cadenza.llm import common

    rows = cases.documents()
    whole = found(spark, rows, 5)
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    assert found(spark, rows, 5) == whole


def test_empty_table_and_no_python(spark):
    assert qr.judge(cases.frame(spark, [])).count() == 0
    plan = qr.judge(cases.frame(spark, cases.documents()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
