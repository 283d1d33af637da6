"""Random keys of all common alphabets and lengths among ordinary text and ordinary identifiers."""

import random

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because each just state those people too mister how little good world make very year still see own work long get here between both life being under never day same another know while last might us great old come since against go came right used take three".split()


def ordinary(rng):
    words = [rng.choice(WORDS) for _ in range(rng.randint(100, 300))]
    for _ in range(2):
        some = [rng.choice(WORDS) for _ in range(rng.randint(3, 6))]
        words.insert(rng.randrange(len(words)), rng.choice([
            "_".join(some), "-".join([*some, str(rng.randint(1, 2024))]), "".join(w.title() for w in some), "".join(some), "/".join(some) + "/" + str(rng.randint(1, 99)), "_".join(some).upper(), str(rng.randint(10**17, 10**18)),
        ]))
    return " ".join(words)


def test_recall_and_false_share(spark):
    from touchline.llm import secret_scan

    rng = random.Random(12)
    up, low, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = {"base62": up + low + digits, "base36": low + digits, "base32": up + "234567", "hex": digits + "abcdef", "upper hex": digits + "ABCDEF", "base64": up + low + digits + "+/"}
    texts, planted = [], {}
    for name, letters in alphabets.items():
        for n in (20, 24, 32, 40):
            for _ in range(10):
                key = "".join(rng.choice(letters) for _ in range(n))
                a, b = ordinary(rng), ordinary(rng)
                planted[len(texts)] = (name, n, len(a) + 1, len(a) + 1 + n)
                texts.append(f"{a} {key} {b}")
    clean = len(texts)
    texts += [ordinary(rng) for _ in range(500)]
    rows = secret_scan.digest(secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    found, false = {}, 0
    for r in rows:
        spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        if r["doc_id"] in planted:
            name, n, start, end = planted[r["doc_id"]]
            hit = any(a < end and start < b for a, b in spans)
            found[name, n] = found.get((name, n), 0) + hit
            false += sum(not (a < end and start < b) for a, b in spans)
        else:
            false += len(spans)
    assert sum(found.values()) >= 0.9 * clean, found
    for name in alphabets:
        assert sum(found[name, n] for n in (20, 24, 32, 40)) >= 34, found
    assert false <= 0.03 * sum(found.values()) and clean == 240
