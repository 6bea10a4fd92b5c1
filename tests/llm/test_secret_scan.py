import hashlib
import random
import re

from penmark.llm import queries, secret_scan

SF = "/root/testdata/sf0.001"
CASE = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
KEYS = "|".join([CASE("password"), CASE("passwd"), CASE("secret"), CASE("token"), CASE("api") + "_?" + CASE("key")])
BASE = [
    ("assign", re.compile(f"({KEYS})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def brute(doc, text):
    found = []
    for k, (kind, regex, group, least) in enumerate(BASE):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in regex.finditer(text or "") if len(m[group]) >= least]
    found.sort()
    n = [sum(k == j for _, k, _ in found) for j in range(3)]
    digest = hashlib.sha256(",".join(s for *_, s in found).encode()).hexdigest()
    return {"doc_id": doc, "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": digest}


def odd():
    rng = random.Random(2)
    bits = ["password", "PassWD", "secret", "TOKEN", "api_key", "ApiKey", "'", '"', " ", "=", ":", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcde",
            "Zz+/_.=-", "ſecret", "toKen", "é", "\n", "ghp_" + "a1B2" * 10, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-12345678901234567", "https://u:pw@host"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)]
    return [*enumerate(texts), (900, None), (901, ""), (902, "password=" + "x" * 200_000), (5, texts[5]), (None, "secret: abcdefghijkl")]


def test_against_brute_force(spark, same, monkeypatch):
    data = odd()
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id long, text string, key_id int, rules string")
    expected = [brute(*r) for r in data]
    same(secret_scan.scan(df).drop("spans"), expected)
    spans = [s for r in secret_scan.scan(df).collect() for s in r.spans.split(",")]
    assert {s.split(":")[0] for s in spans if s} >= {"vcs_token", "private_key", "chat_token", "url_login", "assign", "access", "hex"}
    monkeypatch.setattr(secret_scan, "BROADCAST_ROWS", -1)
    same(secret_scan.scan(df).drop("spans"), expected)
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_query(spark, same):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    same(queries.op2_secret_scan(spark, SF).drop("spans"), [brute(*r) for r in rows])


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("[0-9a-f]+") is None and q("ab") is None and q("(abc|x.)") is None and q("(?:abc)*d") is None
    assert q("abcd") == [frozenset({"abc", "bcd"})]
    assert q("x(abc|def)+y[0-9]") == [frozenset({"abc"}), frozenset({"def"})]
    assert q("api_?key") == [frozenset({"api", "pi_", "i_k", "_ke", "key"}), frozenset({"api", "pik", "ike", "key"})]
    assert q("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert len(q(secret_scan.RULES[0].pattern)) == 6
    for rule in secret_scan.RULES:
        for doc, text in odd():
            for m in rule.regex.finditer(text or ""):
                said = secret_scan._fold(m[0])
                assert q(rule.pattern) is None or any(all(t in said for t in c) for c in q(rule.pattern))


def test_long_logins():
    k = next(k for k, r in enumerate(secret_scan.RULES) if r.kind == "url_login")
    compiled = [r.regex for r in secret_scan.RULES]
    for user, token in (("u", "t" * 129), ("u" * 65, "pw"), ("u" * 3000, "a%2B.-" * 5000), ("u", "p")):
        text = f"see https://{user}:{token}@host.example, and more"
        assert secret_scan.find(text, [k], compiled) == [(9, k, text.index(","))]
    assert secret_scan.find("://a:" * 100_000 + "x" * 1_000_000, [k], compiled) == []  # linear, or it would not end
