import hashlib
import random
import re
import time

import regex

from llm.conftest import ODD, frame, prose
from nearhome.llm import queries, secrets

either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile("(" + "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


KEY, HEX = "AKIA" + "Q" * 16, "0123456789abcdef" * 2
TEXTS = [
    f"password={HEX} then", f"{KEY}", f"{KEY[:-1]} {KEY}A {KEY}", "secret:token:abcdefgh", "token=ab secret='abcdef'", 'API_KEY" : "x.y-z/+=',
    "toKen=abcdefgh ſecret=abcdefgh TOKEN=abcdefgh", f"\U0001f600 é password = {HEX}\U0001f600token=abcdef", "apikey=123456api_key=654321",
    f"{HEX}{HEX} {HEX[:23]} {HEX[:24]}g{HEX}", "password\n=abcdefgh passwd=\tabcdefgh", f"AKIA{KEY}" + "!" * 5, "token=" * 3000 + "abcdef", f"{KEY} " * 400,
]
LINKED = [
    # an identifier near a mixed token, with an endpoint; the same apart; across a blank line; alone
    ("user=alice Ab3dEf6hIj9kLm2nOp5q https://db.example.org/x", ["identifier:0:10", "secret:11:31", "endpoint:32:56"]),
    ("user=alice " + "x " * 200 + "Ab3dEf6hIj9kLm2nOp5q", []),
    ("user=alice\n\nAb3dEf6hIj9kLm2nOp5q", []),
    ("user=alice\nAb3dEf6hIj9kLm2nOp5q", ["identifier:0:10", "secret:11:31"]),
    ("Ab3dEf6hIj9kLm2nOp5q https://db.example.org/x", []),
    (KEY + " Ab3dEf6hIj9kLm2nOp5q", ["access:0:20", "secret:21:41"]),
    ("login: bob pwd: tr0ub4dor&3", ["identifier:0:10", "secret:11:27"]),
    ("nothing here but words and user=alice", []),
]


def brute_linked(text):
    """All spans of a text, every pair of parts looked at."""
    kinds = {k: i for i, k in enumerate(secrets.KINDS)}
    base = [tuple(map(int, (s.split(":")[1], kinds[s.split(":")[0]], s.split(":")[2]))) for s in brute(text).split(",") if s]
    matches = lambda pattern: [m.span() for m in regex.finditer(pattern, text)]
    breaks = [a for a, _ in matches(secrets.BREAK)]
    parts = base + [(a, kinds[k], b) for k, p in (("identifier", secrets.IDENTIFIER), ("secret", secrets.SECRET), ("endpoint", secrets.ENDPOINT)) for a, b in matches(p)]
    scope = lambda part: sum(b <= part[0] for b in breaks)
    near = lambda x, y: scope(x) == scope(y) and (0 <= y[0] - x[2] <= secrets.REACH or 0 <= x[0] - y[2] <= secrets.REACH)
    of = lambda *names: [p for p in parts if secrets.KINDS[p[1]] in names]
    found, reported = set(base), set(of("assign", "hex"))
    for secret in of("secret", "assign", "hex"):
        for other in of("identifier", "access"):
            if near(secret, other):
                found |= {secret, other}
                reported.add(secret)
    found |= {e for e in of("endpoint") for r in reported if near(r, e)}
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def check(spark, rows, path):
    found = queries.op5_secret_scan(spark, path).collect()
    got = sorted((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found)
    expected = []
    for i, text, _ in rows:
        base = brute(text)
        expected.append((str(i), *(base.count(f"{k}:") for k in ("assign", "access", "hex")), hashlib.sha256(base.encode()).hexdigest()))
    assert got == sorted(expected)
    return found


def test_base_spans(spark, folder):
    rows = [(i, t, "a") for i, t in enumerate(TEXTS)]
    found = check(spark, rows, folder(documents=frame(spark, rows)))
    for r in found:
        spans = r["spans"].split(",") if r["spans"] else []
        assert ",".join(s for s in spans if s.split(":")[0] in ("assign", "access", "hex")) == brute(TEXTS[r["doc_id"]])


def test_weak_parts_are_reported_only_together(spark, folder):
    rows = [(i, t, "a") for i, (t, _) in enumerate(LINKED)]
    found = {r["doc_id"]: r["spans"] for r in queries.op5_secret_scan(spark, folder(documents=frame(spark, rows))).collect()}
    assert found == {i: ",".join(s) for i, (_, s) in enumerate(LINKED)}


def linked_spans(spark, folder, texts):
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["spans"] for r in queries.op5_secret_scan(spark, folder(documents=frame(spark, rows))).collect()}
    return [found[i] for i in range(len(texts))]


def test_parts_near_strong_spans_are_reported(spark, folder):
    cases = [
        ("user: bob\npassword: hunter22\nhost: db.example.com", "identifier:0:9,assign:10:28,endpoint:29:49"),
        (f"client_id=abc {HEX}", "identifier:0:13,hex:14:46"),
        ("password: hunter22 host: db.example.com", "assign:0:18,endpoint:19:39"),
        ("user: bob\n\npassword: hunter22", "assign:11:29"),
        ("user: bob " + "x " * 200 + "password: hunter22", "assign:410:428"),
        (f"{KEY} password: hunter22", "access:0:20,assign:21:39"),
    ]
    assert linked_spans(spark, folder, [t for t, _ in cases]) == [s for _, s in cases]


def test_tokens_behind_names_and_with_late_classes(spark, folder):
    late = "aB" * 30 + "7" + "cD" * 10
    small, capital = "A1" * 30 + "z" + "B2" * 5, "g1" * 30 + "Z" + "h2" * 5
    cases = [
        ("user=alice sig=Ab3dEf6hIj9kLm2nOp5q", "identifier:0:10,secret:15:35"),
        ("?user=alice&sig=Ab3dEf6hIj9kLm2nOp5q&x=1", "identifier:1:11,secret:16:36"),
        ('user=alice\nSIG="Ab3dEf6hIj9kLm2nOp5q=="', "identifier:0:10,secret:16:38"),
        *[(f"user=alice {t}", f"identifier:0:10,secret:11:{11 + len(t)}") for t in (late, small, capital)],
        ("user=alice " + "aB" * 200_000, ""),
        ("user=alice a_long_lower_name_of_pwd=hunter22", "identifier:0:10,secret:32:44"),
    ]
    assert linked_spans(spark, folder, [t for t, _ in cases]) == [s for _, s in cases]


def test_parts_in_one_hot_text(spark, folder):
    text = " ".join(f"user=u{i:05d} Ab3dEf6hIj9k{i:05d}Lm2nOp5q" for i in range(3000))
    rows = [(1, text, "a"), (1, text, "a")]
    found = queries.op5_secret_scan(spark, folder(documents=frame(spark, rows))).collect()
    assert [len(r["spans"].split(",")) for r in found] == [6000, 6000]


def test_long_parts_link_on_both_sides(spark, folder):
    long = "x7" * 171 + "A"
    cases = [
        (f"user: bob\nauth: {long}\nhost: db.example.com", "identifier:0:9,secret:10:359,endpoint:360:380"),
        (f"auth: {long}\nuser: bob", "secret:0:349,identifier:350:359"),
        (f"host: {'h' * 5000} user: bob password: hunter22", "endpoint:0:5006,identifier:5007:5016,assign:5017:5035"),
        ("user: bob" + " " * 300 + "password: hunter22", "identifier:0:9,assign:309:327"),
        ("user: bob" + " " * 301 + "password: hunter22", "assign:310:328"),
    ]
    assert linked_spans(spark, folder, [t for t, _ in cases]) == [s for _, s in cases]


def test_linking_by_brute_force(spark, folder):
    pick = random.Random(11)
    part = lambda: pick.choice([
        f"user=u{pick.randrange(999)}", "Ab3dEf6hIj9kLm2nOp5q" + "x" * pick.choice([0, 0, 400]), f"password: {'p' * pick.randint(3, 9)}", "https://db.example.org/x",
        f"host: h{pick.randrange(99)}.example", HEX, KEY, "\n\n", "\n", "é" * pick.randint(1, 350), "pwd=" + "z" * pick.choice([6, 700]), "word " * pick.randint(1, 60),
    ])
    texts = [" ".join(part() for _ in range(pick.randint(1, 25))) for _ in range(300)]
    assert linked_spans(spark, folder, texts) == [brute_linked(t) for t in texts]


def test_planted_credentials(spark, folder):
    """A third of the documents hold credentials in parts, so the join has work to do."""
    texts = [
        prose(i, 40) + (f"\nclient_id: c{i:04d}\nAb3dEf6hIj9kLm2nOp5q{i:05d}\nserver: s{i}.example.net\n" if i % 3 == 0 else " server: lone.example.net ") + prose(i, 40)
        for i in range(3000)
    ]
    found = linked_spans(spark, folder, texts)
    assert found == [brute_linked(t) for t in texts] and sum("endpoint" in s for s in found) == 1000


def test_work_grows_with_the_matches(spark, folder):
    """64,000 matches in one text, 2.6 MB."""
    text = " ".join(f"{i:040x}" for i in range(64_000))
    start = time.time()
    [found] = linked_spans(spark, folder, [text])
    assert found == brute(text) and time.time() - start < 60


def test_odd_documents(spark, odd, none, folder):
    check(spark, ODD, folder(documents=odd))
    assert queries.op5_secret_scan(spark, folder(documents=none)).count() == 0


def test_native(spark, odd):
    plan = secrets.secret_spans(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
