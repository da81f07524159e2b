"""Secrets: patterns against Python's plain search, links against all pairs of parts."""

import hashlib
import random
import re

from racelab.llm import queries as q
from racelab.llm import secret_links as sl

from .test_documents import EDGE, empty, frame

SF = "/root/testdata/sf0.01"
PLAIN = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6, re.I | re.A),
    "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20, 0),
    "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 24, 0),
}


def plain_base(text):
    return {k: [m.span() for m in re.finditer(p, text, flags) if ok(m)] for k, (p, ok, flags) in PLAIN.items()}


def brute_link(base, weak, starts, reach):
    """Every weak part against every other part."""
    every = [*weak, *(sl.Part(s, e, k) for k in sl.BASE for s, e in base[k])]
    scope = lambda p: sum(s <= p.start for s in starts)
    out = []
    for p in weak:
        with_ = [o for o in every if scope(o) == scope(p) and abs(o.start - p.start) <= reach]
        roles = {o.role for o in with_ if o.role != p.role}
        sure = any(o.kind == {"secret": "access", "identifier": "assign"}.get(p.kind) for o in with_)
        if len(roles) == 2 or sure:
            out.append(p)
    return out


def noisy(rng):
    bits = ["user = alice", "pwd: hunter22", "https://db.example.com/x", "host=db1.internal", "AKIA" + "Q7" * 8, "AKIA" + "Z" * 13, "token = 'abcdef12'", 'API_KEY:"x"', "apikey==", "Passwd  :  q.w-e/r+t", "0123456789abcdef01234567", "deadbeef" * 2,
            "aB3dE5fG7hJ9kL1mN3pQ", "\n\n", " \n", "word", "ÿé日", "secret" + " " * 30, "client_id=77-x", "toKen=ſecret99", "AKIAAKIA" + "1" * 14, "api__key=1234567", "=", "://", "a" * 30]
    return "".join(rng.choice(bits) + rng.choice([" ", "", ", ", "\n\n", " " * 40]) for _ in range(rng.randrange(1, 30)))


def test_against_plain_patterns_and_all_pairs():
    rng = random.Random(3)
    linked = 0
    for _ in range(1500):
        text, reach = noisy(rng), rng.choice((20, 100, 300))
        base, found = sl.find(text, reach)
        assert base == plain_base(text)
        weak = sl.weak_parts(text, base)
        assert [p for p, *_ in found] == brute_link(base, weak, sl.scopes(text), reach)
        taken = [s for v in base.values() for s in v] + [(p.start, p.end) for p in weak]
        for p in weak:
            assert sum(s < p.end and p.start < e for s, e in taken) == 1
        linked += len(found)
    assert linked > 500


def test_weak_parts_need_each_other():
    weak = lambda t: sorted((p.kind, t[p.start : p.end]) for p, *_ in sl.find(t)[1])
    assert weak("pwd = hunter22") == [] and weak("user = alice") == [] and weak("see https://example.com/a") == []
    assert weak("user = alice, pwd = hunter22") == []
    assert weak("user = alice, pwd = hunter22 at https://example.com/a") == [("endpoint", "https://example.com/a"), ("identifier", "alice"), ("secret", "hunter22")]
    assert weak("user = alice, pwd = hunter22\n\nat https://example.com/a") == []
    assert weak("user = alice, password = hunter22") == [("identifier", "alice")]
    assert weak("AKIA" + "B2" * 8 + " aB3dE5fG7hJ9kL1mN3pQ5rS7tU9v") == [("secret", "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9v")]
    assert weak("aB3dE5fG7hJ9kL1mN3pQ5rS7tU9v") == []
    assert weak("user = alice" + " x" * 200 + " password = hunter22") == []


def test_query_on_the_table(spark):
    rows = {r.doc_id: r for r in q.op12_secret_links(spark, SF).collect()}
    for i, t in {r.doc_id: r.text for r in q.table(spark, SF, "documents").collect()}.items():
        base = plain_base(t or "")
        flat = sorted((s, sl.BASE.index(k), e) for k in sl.BASE for s, e in base[k])
        text = ",".join(f"{sl.BASE[k]}:{s}:{e}" for s, k, e in flat)
        r = rows[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(base[k]) for k in sl.BASE)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    assert sum(r.n_assign for r in rows.values()) > 0


def test_edges_and_credentials(spark):
    rows = [*EDGE, (11, "user=bob pwd=s3cr3tt url=db.local"), (11, "user=bob pwd=s3cr3tt url=db.local"), (12, "password" * 20_000 + " " * 50_000 + "=" + "AKIA" * 20_000)]
    got = sl.detect(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.spans == "" for r in got if r.doc_id in (1, 2, 3))
    assert [r.n_linked for r in got if r.doc_id == 11] == [3, 3]
    assert sl.detect(empty(spark)).count() == 0 and sl.credentials(empty(spark)).count() == 0
    out = [r for r in sl.credentials(frame(spark, rows)).collect() if r.doc_id == 11]
    assert [(r.kind, r.value, r.identifier_at, r.secret_at, r.endpoint_at) for r in out[:3]] == [("identifier", "bob", 5, 13, 25), ("secret", "s3cr3tt", 5, 13, 25), ("endpoint", "db.local", 5, 13, 25)]
