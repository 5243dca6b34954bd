import hashlib
import random
import re

from skarn.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    v = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in v) % 10 == 0


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def texts():
    rng = random.Random(5)
    pieces = ["4111 1111 1111 1111", "4111111111111111", "+1 (771) 555-1655", "a@b.cc", "x_y.z@q-w.example.com", "10.0.0.1", "0010.2.3.255", "1.2.3.4.5.6.7.8", "256.1.1.1", "@", ".", "-", " ", "é", "😀", "\n", "+", "(", "7", "12", "378282246310005", "_d@e.ff", "..", "%"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    return [None, "", "plain", "a@b.cc_d@e.ff", "1-2-3-4-5-6-7-8-9-0-1-2-3", "9" * 3000, "a" * 20000, "4-" * 4000, "+1" + " " * 3000, *made]


def test_base_spans_against_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = {r["doc_id"]: r for r in pii.digests(docs).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = brute(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (t, got[i], want)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[i]["spans"].split(",")) | {""}


def test_contexts_find_what_the_patterns_miss(spark):
    seeds = [f"please call my office number +1 (200) 555-{1000 + i} between noon and two" for i in range(12)]
    unseen = ["please call my office number 0200-555-77 between noon and two", "there were 20055577 people between noon and two"]
    rows = [*enumerate([*seeds, *unseen]), (13, unseen[1]), (None, None)]
    got = pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["spans"] for r in got}
    at = unseen[0].index("0200")
    assert by[12] == f"phone:{at}:{at + 11}" and by[13] == "" and by[None] == ""


def test_contexts_of_addresses_and_labels(spark):
    names = ["anna", "ben", "carla", "dan", "eva", "finn", "gus", "hal"]
    texts = [f"you can write to {n}.smith@example.org, any time" for n in names] + [f"the server ip=10.0.{i}.1 is up" for i in range(8)]
    unseen = {"anna.smith(at)example.org": "email", "bo [at] example [dot] org": "email", "cy at example dot org": "email", "di@localhost": "email", "10.0.0.1.7/8": None}
    texts += [f"you can write to {u}, any time" if k else f"they wrote {u} once" for u, k in unseen.items()]
    texts += ["the server ip=10-0-0-77 is up", "they met at example dot org once"]
    got = {r["doc_id"]: r["spans"] for r in pii.digests(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    for i, (u, kind) in enumerate(unseen.items(), 16):
        if kind:
            at = texts[i].index(u)
            assert got[i] == f"{kind}:{at}:{at + len(u)}", (u, got[i])
    assert got[21] == "ip:14:23" and got[22] == ""
    assert all(got[i].count(":") == 2 for i in range(16))


def test_hidden_identifiers_are_found(spark):
    rng = random.Random(12)
    filler = ["".join(rng.choice("abdeghiklmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]

    def some(n):
        return " ".join(rng.choice(filler) for _ in range(n))

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    frames = {
        "phone": ["you can reach us at {} during the day", "our office phone number is {} for questions", "please call back on {} before noon"],
        "email": ["send your reply to {} by friday", "write an email to {} for details", "my address is {} these days"],
        "ip": ["the host answered from address {} on port", "login failed for client ip={} again tonight"],
    }
    seen = {"phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}", "email": lambda: f"{rng.choice(filler)}.{digits(2)}@{rng.choice(filler)}.example.com", "ip": lambda: ".".join(str(rng.randint(1, 250)) for _ in range(4))}
    hidden = {"phone": lambda: f"0{digits(3)}-555-{digits(4)}", "email": lambda: f"{rng.choice(filler)}.{digits(2)}(at){rng.choice(filler)}.example.com", "ip": lambda: "-".join(str(rng.randint(1, 250)) for _ in range(4)) + "-77"}
    texts, want = [], set()
    for kind, own in frames.items():
        for n in range(90):
            frame = own[n % len(own)]
            made = (seen if n < 60 else hidden)[kind]()
            before = some(rng.randint(0, 30)) + " " + frame.split("{}")[0]
            if n >= 60:
                want.add((len(texts), f"{kind}:{len(before)}:{len(before) + len(made)}"))
            texts.append(before + made + frame.split("{}")[1] + " " + some(rng.randint(0, 30)))
    # numbers that are none, in contexts of their own and in any
    for n in range(200):
        texts.append(f"{some(9)} " + rng.choice(["order number {} was sent", "in the year {} they came", "it costs {} in all", "{} and", "see page {} there"]).format(digits(rng.choice([4, 5, 8, 11]))) + f" {some(9)}")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = set()
    for r in pii.digests(rows).collect():
        base = {f"{k}:{a}:{b}" for k, a, b in brute(texts[r["doc_id"]])}
        got |= {(r["doc_id"], x) for x in r["spans"].split(",") if x and x not in base}
    assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got), (len(want), len(got), len(want & got), sorted(want - got)[:9], sorted(got - want)[:9])


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é mail x@y.zz or 10.0.0.1.", "en"), (1, "é mail x@y.zz or 10.0.0.1.", "en"), (2, None, "en"), (3, "none", None)], "doc_id long, text string, kind string")
    got = sorted(map(tuple, pii.redacted(docs).collect()), key=str)
    assert got == sorted([(1, "é mail [EMAIL] or [IP].", "en")] * 2 + [(2, None, "en"), (3, "none", None)], key=str)


def test_empty(spark):
    assert pii.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
