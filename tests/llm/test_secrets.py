import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import clashing, frame

from siftstone.llm import automaton, secrets

BASE = [
    (re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    (re.compile(rb"AKIA[A-Z0-9]+"), 0, 18),
    (re.compile(rb"[0-9a-f]+"), 0, 16),
]
SCANNER = secrets.Scanner()


def brute(text):
    found = [(m.start(), m.end(), k) for k, (rule, group, least) in enumerate(BASE) for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[0], s[2]))


PARTS = ["password", "PassWD", "token", "secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABC123", "deadbeef0123", "f", "x", "/", "zz", "abcdefghij", "é", "0123456789abcdef"]


def test_base_rules_agree_with_search_one_by_one():
    random_ = random.Random(2)
    for _ in range(5_000):
        text = "".join(random_.choice(PARTS) for _ in range(random_.randint(0, 14))).encode()
        assert [s for s in SCANNER.find(text) if s[2] < 3] == brute(text), text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14).map("".join))
def test_automata_are_leftmost_longest(text):
    for pattern in ("a+b", "(?:ab|abc)c?", "a{2,3}", "[^c]a*", "(?i:AB)c"):
        rules = (secrets.Rule("r", "", pattern),)
        got = [(a, b) for a, b, _ in secrets.Scanner(rules).find(text.encode())]
        want, at = [], 0
        spans = re.compile(pattern)
        while at < len(text):
            ends = [e for e in range(len(text), at, -1) if spans.fullmatch(text, at, e)]
            if ends:
                want.append((at, ends[0]))
                at = ends[0]
            else:
                at += 1
        assert got == want, (pattern, text)


def test_minimal():
    machine = automaton.compile_rules([automaton.parse("(?:a|b)*abb")], anywhere=False)
    assert len(machine.table) == 5  # four states and the dead one


def test_further_rules():
    text = b"-----BEGIN RSA PRIVATE KEY----- ghp_" + b"a1" * 20 + b" xoxb-1234567890-abc https://me:hidden@host"
    kinds = [secrets.RULES[k].kind for _, _, k in SCANNER.find(text)]
    assert {"private_key", "forge_token", "chat_token", "url_login"} <= set(kinds)


def test_table(spark):
    rows = [(1, 'é token = "abcdefghijkl" 0123456789abcdef'), (2, None), (3, ""), (4, "clean"), (4, "clean"), (None, "AKIA" + "A" * 14), (5, "x" * 200_000 + "f" * 16)]
    found = {(r["doc_id"], r["spans"]): r for r in secrets.span_digest(secrets.find_secrets(clashing(frame(spark, rows)))).collect()}
    assert (1, "assign:2:23,hex:25:41") in found
    assert any(k[0] is None and r["n_access"] == 1 for k, r in found.items())
    assert (5, "hex:200000:200016") in found
    assert secrets.span_digest(secrets.find_secrets(frame(spark, []))).count() == 0
    clean = secrets.redact(frame(spark, rows)).collect()
    assert len(clean) == len(rows)
    by_id = {r["doc_id"]: r for r in clean}
    assert by_id[1]["text"] == 'é [secret]" [secret]' and by_id[1]["n_chars"] == 20
    assert by_id[2]["text"] is None and by_id[4]["text"] == "clean"
