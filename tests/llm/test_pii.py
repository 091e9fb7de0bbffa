import hashlib
import random
import re

from streamspec.llm import pii


def brute(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0]), s[2]))


def base(t, a):
    return [s for s in pii.spans(t, a) if s[0] in pii.BASE_KINDS]


def test_base_spans_are_those_of_the_patterns():
    a, r = pii.automaton(), random.Random(5)
    for alphabet in ("a.@1-+ 2(5é", "12345678 -", "a@.b+", "0.1255 "):
        for _ in range(8000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 45)))
            assert base(t, a) == brute(t), t


def test_generated_documents(docs):
    a = pii.automaton()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.found(docs).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{x}:{y}" for k, x, y in want).encode()).hexdigest()
        assert r.n_email == sum(k == "email" for k, _, _ in want) and r.spans == pii.written(pii.spans(texts[r.doc_id], a))


def test_further_kinds():
    a = pii.automaton()
    t = "IBAN: DE89 3704 0044 0532 0130 00, see https://x.example.com/a?b=1. password=hunter22x Token: word passwords are"
    assert [(k, t[x:y]) for k, x, y in pii.spans(t, a)] == [("account", "DE89 3704 0044 0532 0130 00"), ("url", "https://x.example.com/a?b=1"), ("secret", "hunter22x")]
    assert pii.spans("the account of a password is a token of faith", a) == []
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_mask():
    assert pii.mask("a b@c.de f", [("email", 2, 8)]) == "a <EMAIL> f"
    assert pii.mask("0123456789", [("card", 1, 5), ("phone", 3, 8)]) == "0<CARD>89"


def test_edge_cases(edge, empty):
    rows = pii.found(edge).collect()
    assert len(rows) == 12 and all(r.spans == "" for r in rows if r.doc_id in (1, 2, 3, 4))
    assert pii.found(empty).count() == 0
    m = pii.masked(edge)
    assert m.columns == edge.columns and m.count() == 12 and m.where("doc_id = 1 AND text IS NULL").count() == 1
    assert pii.masked(empty).count() == 0
