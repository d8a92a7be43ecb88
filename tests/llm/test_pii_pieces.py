"""Personal data: every entity of a run without white space, and evidence from anywhere in a document."""

import pytest

from brindle.llm import pii


def clean(text):
    return pii.redact(text, pii.label([text])[0])


@pytest.mark.parametrize("text, want", [
    ("write to a@x.org,b@y.org today", "write to [EMAIL],[EMAIL] today"),
    ("call 555-123-4567,555-987-6543 now", "call [PHONE],[PHONE] now"),
    ("cards 4111-1111-1111-1111;5500-0000-0000-0004 used", "cards [CARD];[CARD] used"),
    ("id,a@x.org,555-123-4567,10.20.30.40,123-45-6789", "id,[EMAIL],[PHONE],[IP],[ID]"),
    ('{"email":"a@x.org","phone":"555-123-4567","ip":"10.20.30.40","n":7}', '{"email":"[EMAIL]","phone":"[PHONE]","ip":"[IP]","n":7}'),
    ("ip=10.0.0.1;mail=a@x.org|phone=555-123-4567", "ip=[IP];mail=[EMAIL]|phone=[PHONE]"),
    ("10.0.0.1/10.0.0.2->a@x.org/555-123-4567", "[IP]/[IP]->[EMAIL]/[PHONE]"),
    ("邮箱是a@x.org请联系555-123-4567谢谢", "邮箱是[EMAIL]请联系[PHONE]谢谢"),
    ('{"password":"ab,cd9;ef","mail":"a@x.org"}', '{"password":"[SECRET]","mail":"[EMAIL]"}'),
])
def test_every_entity_of_a_run(text, want):
    assert clean(text) == want


def test_long_run():
    text = ",".join(f"u{k}@x.org" for k in range(20000))
    assert clean(text) == ",".join(["[EMAIL]"] * 20000)


@pytest.mark.parametrize("text, want", [
    ("the password: correcthorsebattery was set", "the password: [SECRET] was set"),
    ('we set token = "abcdefghijkl" there', 'we set token = "[SECRET]" there'),
    ("call ٥٥٥-١٢٣-٤٥٦٧ now", "call [PHONE] now"),
    ("the key is under the mat, note: nothing else", "the key is under the mat, note: nothing else"),
])
def test_tokens_without_ascii_digits(text, want):
    import pyarrow as pa

    assert pii.clean(pa.array([text]))[0].to_pylist() == [want]


@pytest.mark.parametrize("first, again", [("password: correcthorsebattery", "correcthorsebattery"), ("token=q8w7e6r5t4y3", "q8w7e6r5t4y3")])
def test_evidence_reaches_every_occurrence(first, again):
    text = f"the {first} was set " + f"and {again} it is " * 100
    spans = pii.label([text])[0]
    assert [k for *_, k in spans] == ["SECRET"] * 101
    assert {text[a:b] for a, b, _ in spans} == {again}


def test_long_chains_are_exact():
    import numpy as np

    r, n = np.random.default_rng(3), 400
    unary, t = r.normal(0, 0.01, (n, pii.L)), pii.model()[2] * 0 + 6 * np.eye(pii.L)
    unary[0, 2] = 9
    runs = np.exp(t - t.max())[None]
    old, pii._runs = pii._runs, lambda: runs
    try:
        got = pii.marginals(unary, np.array([0, *[-1] * (n - 1)]), np.array([*[-1] * (n - 1), 0]), np.array([(k, k + 1) for k in range(n - 1)]), np.zeros(n - 1, int), np.zeros((0, 2), int))
    finally:
        pii._runs = old
    a, b = [unary[0]], [np.zeros(pii.L)]
    for i in range(1, n):
        a.append(unary[i] + np.logaddexp.reduce(a[-1][:, None] + t, axis=0))
    for i in range(n - 1, 0, -1):
        b.append(np.logaddexp.reduce(t + (unary[i] + b[-1])[None, :], axis=1))
    want = np.exp(np.array([x + y - np.logaddexp.reduce(x + y) for x, y in zip(a, b[::-1])]))
    assert np.allclose(got, want, atol=1e-4)


@pytest.mark.parametrize("text", [
    "the war of 1914 1918 ended", "from 1999 to 2024", "rooms 2001 2002 2003", "order 4111111111111112 came", "groups 4111 1111 1111 1112 here", "fixed in commit 9fceb02d0ae598e95dc970b74767f19372d61af8",
    "md5 d41d8cd98f00b204e9800998ecf8427e", "at 12:30:45 we met 5551234567 times", "use std::vec and a::b", "call me in 1999", "the token ring and the key point", "chapters 1 2 3 4 5"])
def test_clean_text_is_left_alone(text):
    assert clean(text) == text


@pytest.mark.parametrize("text, want", [
    ("password = hunterpassword", "password = [SECRET]"), ("at 2001:db8::ff00:42:8329 now", "at [IP] now"), ("phone 5551234567", "phone [PHONE]"), ("call 020 7946 0958 now", "call [PHONE] now"),
    ("pay with 4111 1111 1111 1111 today", "pay with [CARD] today"), ("card 4111111111111111 ok", "card [CARD] ok"), ("my ssn 123-45-6789 is", "my ssn [ID] is"), ("ping fe80::1ff:fe23:4567:890a, then", "ping [IP], then")])
def test_entities_in_context(text, want):
    assert clean(text) == want


def _exact(unary, chain, skip, t, s):
    """Marginals by summing over all labellings."""
    import itertools

    import numpy as np

    p = np.zeros_like(unary)
    for y in itertools.product(range(pii.L), repeat=len(unary)):
        w = np.exp(sum(unary[i][k] for i, k in enumerate(y)) + sum(t[y[a], y[b]] for a, b in chain) + sum(s[y[a], y[b]] for a, b in skip))
        for i, k in enumerate(y):
            p[i, k] += w
    return p / p.sum(axis=1, keepdims=True)


def test_loopy_marginals_against_all_labellings():
    """Graphs of five tokens with up to three skip links: the labels agree, and the marginals to 0.1."""
    import numpy as np

    r = np.random.default_rng(8)
    _, _, t, s = pii.model()
    n, chain, off = 5, [(k, k + 1) for k in range(4)], []
    for _ in range(12):
        unary = r.normal(0, 2, (n, pii.L))
        skip = [p for p in [(0, 2), (1, 4), (0, 3)] if r.random() < 0.6]
        got = pii.marginals(unary, np.array([0, -1, -1, -1, -1]), np.array([-1, -1, -1, -1, 0]), np.array(chain), np.zeros(4, int), np.array(skip, int).reshape(-1, 2))
        want = _exact(unary, chain, skip, t, s)
        off.append(np.abs(got - want).max())
        if (np.diff(np.sort(want, axis=1)[:, -2:], axis=1) > 0.2).all():
            assert (got.argmax(1) == want.argmax(1)).all()
    assert np.mean(off) < 0.05 and max(off) < 0.2


def test_skip_links_decide(monkeypatch):
    """Without the links (and the evidence that they share) what has a context once only is found once only."""
    texts = [f"the {first} came, and then {again} was seen there" for first, again in [
        ("password: correcthorsebattery", "correcthorsebattery"), ("phone 5551234567", "5551234567"), ("token = 8a7b6c5d4e3f8a7b", "8a7b6c5d4e3f8a7b")]]
    whole = [len(x) for x in pii.label(texts)]
    monkeypatch.setattr(pii, "skips", lambda keys: [])
    monkeypatch.setattr(pii, "_pooled", lambda feats, keys: feats)
    alone = [len(x) for x in pii.label(texts)]
    assert whole == [2, 2, 2] and sum(alone) < sum(whole)


def test_similar_values_are_linked():
    keys = ["4929123412341234", "x1234", "4929123499999999", "77777712341234", "x1234"]
    assert pii.skips(keys) == [(0, 2), (0, 3), (1, 4)]
