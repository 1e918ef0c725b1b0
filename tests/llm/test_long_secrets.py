"""Secrets of any length, and private keys as a whole."""

import random
import string

from tidemark.llm import secrets


def token(n, seed=1, more=""):
    rng = random.Random(seed)
    return "aB3" + "".join(rng.choice(string.ascii_letters + string.digits + more) for _ in range(n - 3))


def test_long_values():
    for n in (28, 128, 129, 1000, 20000):
        assert [s[2:] for s in secrets.extra_spans(f"session {token(n)} ends")] == [("opaque", token(n))]
    for n, user in ((6, "u"), (128, "u"), (129, "u"), (3000, "u" * 65)):
        assert ("url_password", token(n)) in [s[2:] for s in secrets.extra_spans(f"see db://{user}:{token(n)}@host/x now")]
    inner = "AIza" + token(35)
    assert any(s[2] == "opaque" and len(s[3]) == 300 + len(inner) for s in secrets.extra_spans(token(150) + inner + token(150, 2)))


def test_private_key_is_whole(spark):
    head, foot = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = token(150, 3, "+/")
    key = f"{head}\n{body[:64]}\n{body[64:128]}\n{body[128:]}\n{foot}"
    one_line = f"{head}{body}{foot}"
    rows = [(i, f"copy {i} {k} then text {i}", s) for i, (k, s) in enumerate(zip([key, one_line, key], "abc"))]
    for _, text, _ in rows:
        (a, b, _, value), = [s for s in secrets.extra_spans(text) if s[2] == "private_key"]
        assert value == body and text[a:].startswith(head) and text[:b].endswith(foot)
    mine = token(400, 4, "+/")
    rows += [(9, f"mine {head}{mine}{foot} rest", "a"), (10, f"cut {head}\n{mine[::-1]} and prose", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    red = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert red[9] == "mine <private_key> rest" and red[10] == "cut <private_key> and prose"
    assert all(red[i] == rows[i][1] for i in range(3))


def plain_spans(rows):
    """Base and added spans per row, ownership counted by hand."""
    holders = {}
    for i, text, source in rows:
        for s in sum(secrets.candidates(text), []):
            holders.setdefault(s[3], set()).add((source, i))
    out = []
    for i, text, source in rows:
        base, extra = secrets.candidates(text)
        wide = lambda v: len({o for o, _ in holders[v]}) >= secrets.EXAMPLE_OWNERS or len(holders[v]) >= secrets.EXAMPLE_REPOS
        odd = lambda v: bool(secrets.PLACEHOLDER.search(v)) or secrets.entropy(v) < secrets.LEAST_ENTROPY
        kept = base + [s for s in extra if not wide(s[3]) and not odd(s[3])]
        out.append((i, secrets.joined(sorted(kept, key=lambda s: (s[0], secrets.KINDS.index(s[2]))))))
    return sorted(out)


def planted(rng, n):
    head = rng.choice(["RSA ", "", "EC ", "OPENSSH "])
    body = token(150, n, "+/")
    return rng.choice([
        (f"-----BEGIN {head}PRIVATE KEY-----\n{body[:64]}\n{body[64:128]}\n{body[128:]}\n-----END {head}PRIVATE KEY-----", body),
        (f"-----BEGIN {head}PRIVATE KEY-----{body}-----END {head}PRIVATE KEY-----", body),
        (f"-----BEGIN {head}PRIVATE KEY-----\n{body[:64]}\n{body[64:128]}\n{body[128:140]}\n", body[:140]),
        (f"ghp_{token(36, n)}", token(36, n)), (f"password = {token(160, n)}", token(160, n)), (f"db://u:{token(200, n)}@h/x", token(200, n)), (token(300, n), token(300, n)),
    ])


def test_spans_and_redaction(spark, monkeypatch):
    monkeypatch.setattr(secrets, "EXAMPLE_REPOS", 8)
    rng = random.Random(12)
    pool = [planted(rng, n) for n in range(60)]
    rows, inside = [], {}
    for i in range(400):
        own = [pool[min(59, int(rng.expovariate(0.07)))] for _ in range(rng.randrange(3))]
        rows.append((i, "\n".join(["start of text", *[x for p in own for x in (p[0], "some words between here")]]), rng.choice("aaab" if i % 3 else "abcde")))
        inside[i] = [v for _, v in own]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = plain_spans(rows)
    got = secrets.secrets(df).select("doc_id", "spans_text").collect()
    assert sorted((r.doc_id, r.spans_text) for r in got) == want
    marks, texts = dict(want), {r[0]: r[1] for r in rows}
    gone = kept = 0
    for r in secrets.redact(df).collect():
        spans = [tuple(x.rsplit(":", 2)) for x in marks[r.doc_id].split(",") if x]
        assert r.text == secrets.blank_out(texts[r.doc_id], [(int(a), int(b), k) for k, a, b in spans])
        for v in inside[r.doc_id]:
            at = texts[r.doc_id].replace("\n", "").find(v)
            whole = v.replace("\n", "") in r.text.replace("\n", "")
            assert at >= 0
            if not whole:  # then nothing of it is left, not even a line's worth
                assert all(v[j : j + 12] not in r.text.replace("\n", "") for j in range(0, len(v) - 12))
            gone, kept = gone + (not whole), kept + whole
    assert gone > 50 and kept > 50


def test_key_without_body_and_unterminated():
    assert secrets.private_keys("see the -----BEGIN RSA PRIVATE KEY----- header, please") == []
    text = "-----BEGIN PRIVATE KEY-----\n" + "A1b2" * 16 + "\nQq\nand prose follows"
    (a, b, _, _), = secrets.private_keys(text)
    assert text[b:] == "\nand prose follows" and a == 0
    long = "-----BEGIN " + "ABC " * 20000 + "PRIVATE KEY-----" + "A1b2" * 50000
    assert secrets.private_keys(long)[0][:2] == (0, len(long))
