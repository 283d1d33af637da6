"""The native scans: what the methods add is found, and long texts of one class of characters end."""

import random
import re

import pytest


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9))) for _ in range(n))


def spans(row, kind):
    return [tuple(map(int, x.split(":")[1:])) for x in row["spans"].split(",") if x.startswith(kind + ":")]


def test_planted_keys(spark):
    from touchline.llm import secret_scan

    rng = random.Random(21)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    texts, want = [], {}
    for i in range(200):
        key = "".join(rng.choice(alphabets[i % 3]) for _ in range(40))
        before = f"{prose(rng, 40)} {['', 'AWS_ACCESS_KEY=', 'key: '][i % 3]}"
        texts.append(f"{before}{key} {prose(rng, 20)} characteristically_internationalised/some/other/path_to_thing")
        want[i] = (len(before), len(before) + len(key))
    texts += [f"{prose(rng, 60)} internationalisation myVeryLongCamelCaseIdentifierName" for _ in range(300)]
    rows = secret_scan.digest(secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    found = {r["doc_id"]: spans(r, "random") for r in rows}
    assert sum(w in found[i] for i, w in want.items()) >= 0.9 * len(want)
    assert sum(len(v) for v in found.values()) - len(want) <= 0.02 * len(want)


def test_repeated_rows_have_the_same_spans(spark):
    from touchline.llm import pii_scan, secret_scan

    rows = [(1, "mail ann@x.org, token=abcdef123"), (1, "mail ann@x.org, token=abcdef123"), (None, "mail ann@x.org, token=abcdef123")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["spans"] for r in pii_scan.digest(pii_scan.find_personal_data(d)).collect()} == {"email:5:14"}
    assert {r["spans"] for r in secret_scan.digest(secret_scan.find_secrets(d)).collect()} == {"assign:16:31"}


def test_planted_personal_data(spark):
    """Local phone numbers, identity numbers and spelled-out addresses, which no base pattern has."""
    from touchline.llm import pii_scan

    rng = random.Random(22)
    texts, want = [], {}
    for i in range(300):
        n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))  # noqa: B023, E731
        lead, item = [("call ", f"{n(3)}-{n(3)}-{n(4)}"), ("phone: ", f"({n(3)}) {n(3)}-{n(4)}"), ("mail ", f"{prose(rng, 1)} [at] {prose(rng, 1)} [dot] com")][i % 3]
        before = prose(rng, 30) + " " + lead
        texts.append(before + item + " " + prose(rng, 30))
        want[i] = (len(before), len(before) + len(item))
    texts += [f"{prose(rng, 30)} version {rng.randrange(99)}.{rng.randrange(99)}, page {rng.randrange(999)} of {rng.randrange(9999)} {prose(rng, 30)}" for _ in range(300)]
    texts += [f"{prose(rng, 10)} contact user{i}@mail{i}.example.com or +1 212 555 01{i % 100:02d} {prose(rng, 10)}" for i in range(200)]
    rows = pii_scan.digest(pii_scan.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    found = {r["doc_id"]: [(s, e) for k in ("local_phone", "spelled_email") for s, e in spans(r, k)] for r in rows}
    assert sum(w in found[i] for i, w in want.items()) >= 0.9 * len(want)
    assert not any(r["spans"] for r in rows if 300 <= r["doc_id"] < 600)


N = 300_000


@pytest.mark.parametrize("text", ["1" * N, "a@b" + ".c" * (N // 2), "a" * N, "a@" * (N // 2), "+1" + " (0" * (N // 3), "1." * (N // 2), "._" * (N // 2), "a (at) b" + " (dot) c" * (N // 8), "user@mail.com " * (N // 14), "x@a.b_" * (N // 6)], ids=lambda t: t[:9])
def test_long_runs(spark, text):
    """Matches equal those of a plain matcher, whatever the length of a run."""
    from touchline.llm import pii_scan

    r = pii_scan.digest(pii_scan.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    mails = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    ips = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)] if "." in text else []
    assert (r["n_email"], r["n_ip"]) == (len(mails), len(ips)) and spans(r, "email") == mails and spans(r, "ip") == ips


def test_many_tokens_and_bases(spark):
    """Spans that share no character with others are the same by the short and the long way."""
    from pyspark.sql import functions as F

    from touchline.llm.native_spans import apart, running_maxima, running_sums

    rng = random.Random(2)
    for n in (5, 400):
        cut = sorted(rng.sample(range(10 * n), 4 * n))
        a = [(s, e) for s, e in zip(cut[::4], cut[1::4], strict=True)]
        b = sorted((x := rng.randrange(10 * n), x + rng.randrange(1, 9)) for _ in range(n))
        d = spark.createDataFrame([(a, b)], "a array<struct<start:int,end:int>>, b array<struct<start:int,end:int>>")
        got = [tuple(x) for x in d.select(F.expr(apart("a", "b"))).first()[0]]
        assert got == [(s, e) for s, e in a if not any(o < e and s < p for o, p in b)]
    x = [rng.randrange(-9, 9) for _ in range(700)]
    sums, most = spark.createDataFrame([(x,)], "x array<int>").select(F.expr(running_sums("x")), F.expr(running_maxima("x"))).first()
    assert sums == [sum(x[: i + 1]) for i in range(700)] and most == [max(x[: i + 1]) for i in range(700)]
