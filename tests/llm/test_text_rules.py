"""Quality rules and secret scans against plain computations, and awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from rows import SF, awkward, documents, empty  # noqa: F401 - fixtures
from textlab.llm import quality, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text: str) -> tuple:
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    cover = {k for i in range(len(words) - 7) if win[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def plain_bucket(v: int) -> int:
    return v if v < 32 else v >> (v.bit_length() - 5) << (v.bit_length() - 5)


def plain_verdicts(rows: list, min_group: int) -> list[bool]:
    def ms(s, lines):
        return {"symbols_pm": s[2] * 1000 // s[0], "dup_lines_pm": s[3] * 1000 // lines, "repeat_pm": s[4] * 1000 // s[0], "word_len_c": s[1] * 100 // s[0]}

    data = [(r, plain_stats(r.text or ""), sum(bool(WORD.search(x)) for x in (r.text or "").split("\n"))) for r in rows]
    data = [(r, s, ms(s, n) if s[0] else None) for r, s, n in data]

    def quart(group, m, percent):
        v = sorted(plain_bucket(x[m]) for x in group)
        return v[max(0, -(-percent * len(v) // 100) - 1)]

    out = []
    for r, s, own in data:
        if s[0] < 20 or 100 * s[4] > 30 * s[0]:
            out.append(False)
            continue
        group = [x for o, _, x in data if x and (o.lang, o.source) == (r.lang, r.source)]
        if len(group) < min_group:
            group = [x for o, _, x in data if x and o.lang == r.lang]
        if len(group) < min_group:
            group = [x for _, _, x in data if x]
        ok = True
        for m, (side, level) in quality.FENCES.items():
            far = max(4 * (quart(group, m, 75) - quart(group, m, 25)), 32)
            ok &= own[m] <= quart(group, m, level) + far and (side == "high" or own[m] >= quart(group, m, 100 - level) - far)
        out.append(ok)
    return out


def test_random_texts_have_the_plain_stats():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a ", "b ", "c\n", "# ", "é", "\x0b", " ", "a b c d e f g h ", "x\n"]) for _ in range(rng.randint(0, 60)))
        assert quality.stats(text.encode())[:5] == plain_stats(text)


@pytest.mark.parametrize("min_group", [1, 30, 200])
def test_verdicts_equal_brute_force(spark, documents, min_group):
    rows = documents.collect()
    want = {r.doc_id: k for r, k in zip(rows, plain_verdicts(rows, min_group))}
    got = quality.judge(documents, min_group=min_group).collect()
    assert {r.doc_id: r.kept for r in got} == want
    assert sorted(r.doc_id for r in quality.keep_good(documents, min_group=min_group).collect()) == sorted(d for d, k in want.items() if k)


def test_a_group_decides_by_its_own_spread(spark):
    """Two sources with other habits: the same text is usual in one and stands out in the other."""
    def text(k: int, long: int) -> str:
        return " ".join(f"w{k}x{i}" + "y" * long for i in range(40))

    rows = [(k, text(k, k % 3), "en", "short", 0) for k in range(100)] + [(k, text(k, 8 + k % 9), "en", "long", 0) for k in range(100, 200)]
    rows += [(200, text(200, 11), "en", "short", 0), (201, text(200, 11), "en", "long", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, min_group=50).collect()}
    assert not kept[200] and kept[201] and sum(kept.values()) == 201


def test_quality_of_awkward_rows(spark, awkward, empty):
    got = quality.judge(awkward).collect()
    assert len(got) == awkward.count() and all(r.kept is not None for r in got)
    assert [r.n_words for r in got if r.doc_id is None and r.n_words == 0] == [0]
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns and kept.count() == 0
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


def plain_base(text: str) -> list:
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans_of_random_texts():
    rng = random.Random(2)
    bits = ["password", "PassWd", "ſecret", "toKen", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc", "deadbeef01", "AKIA", "ABCD1234EFGH", "0f" * 13, "é", "x.y-"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert sorted(secret_scan.base_spans(text)) == plain_base(text)


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def test_incremental_entropy_equals_direct():
    rng = random.Random(3)
    for _ in range(200):
        s = "".join(rng.choice("abcdef0123456789"[:rng.randint(1, 16)]) for _ in range(rng.randint(0, 60)))
        for least in (1.0, 2.5, 3.0):
            assert secret_scan.high_entropy(s, 20, least) == [i for i in range(len(s) - 19) if entropy(s[i:i + 20]) >= least - 1e-9]


def test_entropy_spans_and_allow_list():
    key = "q7Zx9LmP2vRt8KwYb3NcD5hJ"
    assert secret_scan.entropy_spans(f"see {key} there") == [(4, 4, 4 + len(key))]
    for clean in ("internationalizationandlocalization", "0123456789012345678901234567890", "https//www/some/very/long/path/2024/01/02", "a" * 50 + "1",
                  "EXAMPLEq7Zx9LmP2vRt8KwYEXAMPLE"):
        assert secret_scan.entropy_spans(clean) == [], clean
    base, every = secret_scan.scan(f"token = {key}")
    assert base == every and secret_scan.redact(f"x token = {key} y") == "x [SECRET] y"


def test_a_placeholder_excuses_its_own_part_only():
    key = "Zk39LmP2vRt8KwYb3NcD5hJq"
    for text in (f"sample_key={key}", f"/examples/deploy/{key}", f"resample-job_{key}", f"exampleKey={key}", f"{key}/sample2"):
        at = text.index(key)
        assert any(a <= at and at + len(key) <= b for a, _, b in secret_scan.entropy_spans(text)), text
        assert key not in secret_scan.redact(text)
    rng = random.Random(4)
    blob = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWYZabcdefghjkmnpqrstuvwyz23456789") for _ in range(4000))
    spans = secret_scan.entropy_spans(blob[:2000] + "xXxx" + blob[2000:])
    assert spans[0][0] < 40 and spans[-1][2] > 3960 and sum(b - a for a, _, b in spans) > 3800
    for clean in ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "key=EXAMPLEq7Zx9LmP2vRt8KwYb3", "xxxx-xxxx-xxxx-1234-xxxx"):
        assert secret_scan.entropy_spans(clean) == [], clean


def test_scan_query_rows(spark, documents, awkward, empty):
    for r, t in zip(secret_scan.find_secrets(documents).orderBy("doc_id").collect(), documents.orderBy("doc_id").collect()):
        want = plain_base(t.text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in want) for k in range(3))
    assert secret_scan.find_secrets(awkward).count() == awkward.count() and secret_scan.find_secrets(empty).count() == 0
    assert sorted(map(str, secret_scan.without_secrets(awkward).collect())) == sorted(map(str, awkward.collect()))
    redacted = secret_scan.without_secrets(spark.createDataFrame([(1, "my password: hunter2hunter2 ok", "en", "a", 30)], documents.schema))
    assert redacted.first().text == "my [SECRET] ok" and redacted.first().n_chars == 14
