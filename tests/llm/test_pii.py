import hashlib
import random
import re

from causeway.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for rank, (kind, pat) in enumerate(PLAIN.items()):
        for m in re.finditer(pat, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


BITS = ["a@b.c", "a@b.c_x@d.e", "x.y%z@mail-1.example.com.", "a@b", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.255", "0.0.0.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713000", "+1 (743) 555-3824", "+12", "+1.2.3.4.5.6.7.8.9.0", "+44 20 7946 0958+1 212 555 0000", "é", "😀", "word", "token = \"f33e\"", "\n", " ", ".", "-", "99999999999999999999", "00000000000000", "%", "_@b.co"]


def texts():
    r = random.Random(3)
    out = ["".join(r.choice(BITS) + r.choice(["", " ", " the "]) for _ in range(r.randint(0, 14))) for _ in range(400)]
    return out + [None, "", "1" * 50_000, "a" * 50_000, "1 " * 20_000, "a@" * 5_000, "1.2.3.4 " * 700, "+1" * 5_000, "a@b.c " * 600]


def test_base_spans_equal_plain_regexes(spark):
    rows = [(i % 300, t, "v") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, value string")
    got = sorted((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.digest(df).collect())
    want = []
    for i, t, _ in rows:
        b = base(t)
        want.append((i, hashlib.sha256(",".join(b).encode()).hexdigest(), *(sum(x.startswith(k + ":") for x in b) for k in pii.KINDS)))
    assert got == sorted(want)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"Please note my mail is user{i}@mail.example.com today") for i in range(8)]
    rows += [(100, "Please note my mail is user9_at_mail today"), (101, "It has nothing to do with user9_at_other"), (102, None), (103, "")]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "email:23:45"
    assert got[100] == "context_email:23:36"
    assert got[101] == "" and got[102] == "" and got[103] == ""


def test_mask(spark):
    rows = [(1, "to a@b.co, 10.0.0.1!", "x", 1), (2, None, "y", 2), (3, "none", "z", 3), (4, "+1 (743) 555-3824", "z", 3), (4, "mail 4111111111111111@b.co", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, spans int")
    out = pii.mask(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "to [EMAIL], [IP]!"), (2, ""), (3, "none"), (4, "[PHONE]"), (4, "mail [EMAIL]")]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(df).count() == 0 and pii.mask(df).count() == 0


def test_long_texts_take_time_in_proportion(spark):
    import time

    df = spark.createDataFrame([(1, "1 " * 75_000), (2, "my mail is a@b.co " * 8_000)], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r.n_email for r in pii.digest(df).collect()}
    assert got == {1: 0, 2: 8_000}
    assert {r.doc_id: r.text.count("[EMAIL]") for r in pii.mask(df).collect()} == {1: 0, 2: 8_000}
    assert time.time() - start < 180


def plain_learn(places, rounds=pii.ROUNDS, least=pii.MIN_SEEDS, trust=pii.TRUST):
    """The graph of contexts and values with dictionaries: (context, kind) -> confidence."""
    kinds, values = {}, {}
    for context, value, kind in places:
        if context is not None:
            values.setdefault(context, set()).add(value)
            if kind is not None:
                kinds[context, value] = max(kind, kinds.get((context, value), kind))
    seeds = {(v, k): 1.0 for (_, v), k in kinds.items()}
    trusted, patterns = dict(seeds), {}
    for _ in range(rounds):
        patterns = {}
        for c, vs in values.items():
            for kind in {k for _, k in trusted}:
                mine = [trusted[v, kind] for v in vs if (v, kind) in trusted]
                if len(mine) >= least and sum(mine) / len(vs) >= trust:
                    patterns[c, kind] = sum(mine) / len(vs)
        miss = {}
        for (c, kind), p in patterns.items():
            for v in values[c]:
                if (c, v) not in kinds:
                    miss[v, kind] = miss.get((v, kind), 1.0) * max(1e-9, 1 - p)
        trusted = dict(seeds)
        for k, m in miss.items():
            if 1 - m >= trust:
                trusted[k] = max(trusted.get(k, 0.0), 1 - m) if k not in seeds else trusted[k]
    return patterns


def test_learning_equals_plain_graph(spark):
    from causeway.llm.common import Scratch

    r = random.Random(6)
    places = []
    for _ in range(600):
        c, v = f"c{r.randint(0, 11)}", f"v{r.randint(0, 59)}"
        n = int(v[1:])
        places.append((None if r.random() < 0.05 else c, v, "email" if n < 22 else "phone" if n < 40 else None))
    places = [p for p in places if p[0] is None or int(p[0][1:]) % 3 != 0 or p[2] != "phone"]
    df = spark.createDataFrame(places, "context string, value string, kind string")
    got = {(x.context, x.kind): round(x.confidence, 9) for x in pii.learn(df, Scratch(spark, "t"), trust=0.4).collect()}
    assert got == {k: round(v, 9) for k, v in plain_learn(places, trust=0.4).items()} and got
