import hashlib
import random
import re

from siftline.llm import sanitise

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check(df, texts):
    got = {r["doc_id"]: r for r in sanitise.report(df).collect()}
    assert len(got) == len(texts)
    for doc, text in texts.items():
        want = plain_spans(text)
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        row = got[doc]
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (text, base, row)
        for kind in PLAIN:
            assert row[f"n_{kind}"] == sum(k == kind for k, _, _ in want)
        assert [s for s in row["spans"].split(",") if s and not s.startswith("term")] == [s for s in base.split(",") if s]


def test_given_documents(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    check(df, {r["doc_id"]: r["text"] for r in df.collect()})


def test_edges(documents):
    random.seed(5)
    texts = [
        None, "", "no data", "a@b.c_d@e.f g@@h.i x%y@z.w.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4041894974608795 4041-8949 7460 8795 4041894974608796",
        "+1 (988) 555-2485 +1 23 +49 30 1234 5678 9012 3456", "\U0001F600 é a@b.cc \U0001F600+123456789", "9" * 3000, "a" * 50_000, "@" * 2000, "+1(" * 500,
        ("1.2.3.4 " * 1500), "4 " * 5000, "+" + "1 " * 4000,
    ] + ["".join(random.choices("ab1 2.@+-%_(é\U0001F600 ", k=60)) for _ in range(150)]
    check(documents(list(enumerate(texts))), dict(enumerate(texts)))


def test_empty_table(documents):
    assert sanitise.report(documents([])).count() == 0
    assert sanitise.sanitise(documents([])).count() == 0


def test_terms_that_only_stand_near_addresses_are_spans(documents):
    texts = {k: f"filler words here and then zorp u{k}.x@mail.example.com follows with much other text" for k in range(6)}
    texts |= {k: "words with much other text here and then follows filler " * 40 for k in range(6, 12)}
    got = {r["doc_id"]: r["spans"] for r in sanitise.report(documents(list(texts.items()))).collect()}
    assert all(f"term:{texts[k].index('zorp')}:{texts[k].index('zorp') + 4}" in got[k].split(",") for k in range(6))
    assert all(got[k] == "" for k in range(6, 12))
    clean = {r["doc_id"]: r["sanitised"] for r in sanitise.sanitise(documents(list(texts.items()))).collect()}
    assert "@" not in clean[0] and "[EMAIL]" in clean[0] and "zorp" not in clean[0] and clean[7] == texts[7]


def test_disclosing_terms_are_spans_in_every_text(spark, documents):
    near = "filler words here and then zorp u{}.x@mail.example.com follows"
    texts = {k: near.format(k) for k in range(30, 60)}
    texts |= {0: near.format(0) + " words with much other text" * 20 + " \U0001F600 Zorp, ends"}
    texts |= {k: "words with much other text here and then follows filler " * 400 for k in range(8, 14)}
    texts |= {20: "no address, but ZORP and zorp's too; zorps zorp2 x-zorp not", 21: "zorp..a@b.cc \u00e9zorp.@b.cc zorp.", 22: None, 23: ""}
    got = {r["doc_id"]: r["spans"].split(",") for r in sanitise.report(documents(list(texts.items()))).collect()}
    for k, text in texts.items():
        glued = {21: [0], 20: [text.index("zorps"), text.index("zorp2"), text.index("x-zorp") + 2] if k == 20 else []}.get(k, [])
        places = [m.start() for m in re.finditer(r"(?<!\u00e9)zorp", (text or "").lower()) if m.start() not in glued]
        want = [f"term:{p}:{p + 4}" for p in places]
        assert [s for s in got[k] if s.startswith("term")] == want, (k, got[k], want)
    clean = {r["doc_id"]: r["sanitised"] for r in sanitise.sanitise(documents(list(texts.items()))).collect()}
    assert "zorp" not in clean[0].lower() and clean[9] == texts[9] and clean[22] is None
    assert clean[20] in ("no address, but  and 's too; zorps zorp2 x-zorp not", "no address, but [EMAIL] and [EMAIL]'s too; zorps zorp2 x-zorp not")
    assert clean[21].startswith("[EMAIL]")


def test_a_term_beside_one_value_only_is_a_span(documents):
    near = "filler words here and then {} {} follows with much other text"
    texts = {k: near.format("Zorp", "one.x@mail.example.com" if k % 2 else "ONE.x@Mail.example.com") for k in range(5)}
    texts |= {k: near.format("Quux", f"u{k}.x@mail.example.com") for k in range(10, 12)}  # two places are chance
    texts |= {k: near.format("card", f"u{k}.x@mail.example.com") for k in range(20, 60)}
    texts |= {k: "words with much other text here and then follows filler card " * 100 for k in range(60, 70)}
    texts |= {70: "Ask zorp, or quux."}
    got = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("term")] for r in sanitise.report(documents(list(texts.items()))).collect()}
    assert got[70] == ["term:4:8"]
    assert all(got[k] == [f"term:{texts[k].index('Zorp')}:{texts[k].index('Zorp') + 4}"] for k in range(5))
    assert not any(got[k] for k in got if 5 <= k < 70)
