"""Quality rules against direct computation."""

import collections
import re

import numpy as np
import pytest

from fixtures import PROSE, SMALL, documents, odd_rows
from marketloom.llm import quality


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = collections.Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(inside),
    ), len(lines)


def vector(numbers, n_lines):
    n, chars, symbols, dup_lines, repeats = numbers
    angle = lambda part, of: np.arcsin(np.sqrt(min(part / max(of, 1), 1)))
    values = [np.log(max(chars / max(n, 1), 1)), angle(symbols, chars), angle(dup_lines, n_lines),
              angle(repeats, n)]
    return np.floor(np.array(values) * quality.GRID + 0.5)


P = len(quality.FEATURES)
LEAST = np.diag((np.array(quality.LEAST_DEVIATION) * quality.GRID) ** 2)


def distances(x, center, cov):
    away = x - center
    return np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov + LEAST), away)


def moments(rows, share):
    factor = share / quality.chi2_cdf(quality.chi2_quantile(share, P), P + 2)
    return rows.mean(0), np.cov(rows.T, bias=True).reshape(P, P) * factor


def robust_moments(x):
    """Minimum covariance determinant by concentration steps from two starts, dense matrices."""
    ends = []
    for center, cov in ((np.median(x, axis=0), np.zeros((P, P))), moments(x, quality.INSIDE)):
        det = np.inf
        while True:
            step = np.floor(np.log2(distances(x, center, cov) + 1 / 1024) * 64)
            cut = np.sort(step)[int(np.ceil(len(x) * quality.CORE_SHARE - 1e-9)) - 1]
            moved = moments(x[step <= cut], quality.CORE_SHARE)
            lower = np.linalg.det(moved[1] + LEAST)
            if not lower < det * (1 - quality.FALL):
                break
            det, (center, cov) = lower, moved
        ends.append((det, center, cov))
    _, center, cov = min(reversed(ends), key=lambda e: e[0])
    inner = x[distances(x, center, cov) <= quality.chi2_quantile(quality.INSIDE, P)]
    return len(inner), *moments(inner, quality.INSIDE)


def robust_distances(x, language):
    size, center, cov = robust_moments(x)
    _, pooled_center, pooled_cov = robust_moments(language)
    inside = distances(center[None], pooled_center, pooled_cov)[0] <= quality.chi2_quantile(quality.INSIDE, P)
    own = size / (size + quality.SHRINK) if inside else 0
    return distances(
        x, pooled_center + own * (center - pooled_center), pooled_cov + own * (cov - pooled_cov)
    )


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs.collect(), {r.doc_id: r for r in quality.quality_rules(docs).collect()}


def test_statistics(judged):
    for doc in judged[0]:
        r = judged[1][doc.doc_id]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == statistics(doc.text)[0], doc.doc_id
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])


def test_distances(judged):
    groups = collections.defaultdict(list)
    for doc in judged[0]:
        if not judged[1][doc.doc_id].base_failed:
            groups[doc.lang, doc.source].append(doc)
    limit = quality.chi2_quantile(1 - quality.OUTSIDE, 4)
    vectors = lambda docs: np.array([vector(*statistics(d.text)) for d in docs])
    for (lang, _), docs in groups.items():
        language = [d for (other, _), some in groups.items() if other == lang for d in some]
        expected = robust_distances(vectors(docs), vectors(language))
        for doc, distance in zip(docs, expected):
            r = judged[1][doc.doc_id]
            assert r.distance == pytest.approx(distance, abs=1e-6)
            assert r.kept == (distance <= limit)


def test_quantiles():
    assert quality.chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)
    assert quality.chi2_cdf(5.385, 4) == pytest.approx(0.75, abs=1e-3)


def test_one_group_with_outliers(spark):
    good = [(i, PROSE + f" tail{i} end{i * 7}") for i in range(30)]
    bad = [(100 + i, " ".join(w + "###" for w in PROSE.split()) + f" {i}") for i in range(8)]
    rows = quality.quality_rules(documents(spark, good + bad)).collect()
    assert {r.doc_id for r in rows if r.kept} == {i for i, _ in good if i != 3} | {3}
    assert quality.keep_good(documents(spark, good + bad)).count() == 30


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert PROSE in texts and None not in texts and "" not in texts
    assert sum(t == PROSE for t in texts) == 3  # both repeated rows and the row without an id


def de_bruijn(names):
    """Words in an order in which no three-word window comes twice."""
    seen, out = set(), [names[0], names[0]]
    while True:
        for n in reversed(names):
            if (*out[-2:], n) not in seen:
                seen.add((*out[-2:], n))
                out.append(n)
                break
        else:
            return out


JUNK = {
    "symbols": lambda w, i: w[:-1] + ["|" * round(0.065 * len("".join(w)))] + [f"t{i}"],
    "lines": lambda w, i: "\n".join(de_bruijn([f"abc{k}x{i}" for k in range(6)]) + [f"line{k}x{i}" for k in range(12)]).split(" "),
    "repeats": lambda w, i: w[:64] + w[:21] + [f"t{i}"],
    "word_length": lambda w, i: [x + x[:6] for x in w] + [f"t{i}"],
}


@pytest.mark.parametrize("kind", sorted(JUNK))
def test_one_statistic_rejects_alone(spark, kind):
    good = [(i, PROSE + f" tail{i} end{i * 7}") for i in range(40) if i != 3]
    bad = [(100 + i, " ".join(JUNK[kind](PROSE.split(), i))) for i in range(3)]
    rows = quality.quality_rules(documents(spark, good + bad)).collect()
    assert not any(r.base_failed for r in rows)
    assert {r.doc_id for r in rows if r.kept} == {i for i, _ in good}
    assert all(r.distance < 38.2 for r in rows)  # all of these were kept at a tail of 1e-7


def grouped(spark, rows):
    """(doc_id, text, source) rows of one language."""
    return spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id bigint, text string, lang string, source string")


@pytest.mark.parametrize("n_junk, n_good", [(1, 0), (2, 0), (2, 1), (5, 0), (3, 2), (30, 0)])
def test_small_and_one_sided_sources(spark, n_junk, n_good):
    good = [(i, PROSE + f" tail{i} end{i * 7}", f"s{i % 3}") for i in range(60)]
    few = [(200 + i, PROSE + f" tail{i} end{i * 5}", "odd") for i in range(n_good)]
    bad = [(300 + i, " ".join(JUNK["symbols"](PROSE.split(), i)), "odd") for i in range(n_junk)]
    rows = quality.quality_rules(grouped(spark, good + few + bad)).collect()
    assert {r.doc_id for r in rows if r.kept} == {i for i, _, _ in good + few}
