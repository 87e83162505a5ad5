import random
import re
import time
from hashlib import sha256

import pytest

from tests.llm.helpers import awkward, awkward_rows, empty
from vigil.llm import pii as P

PLAIN = {  # the patterns as they are stated, applied by plain search
    0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    1: re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    2: re.compile(r"[0-9]([\x20-]?[0-9])+"),
    3: re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == 1:
        return all(int(x) <= 255 for x in s.split("."))
    if kind == 2:
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PLAIN.items() for m in p.finditer(text or "") if passes(k, m[0])]


def card(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if passes(2, body + c))


def test_base_spans_equal_the_stated_patterns():
    rng = random.Random(4)
    pieces = ["@", ".", "-", "+", " ", "a", "b1", "x.y", "@a.b", "1", "12", "300", "1.2.3.4", "(", ")", "é", "\n", "4111 1111 1111 1111", "+49 30 1234567", "_", "%", "0.0.0.0", "٣"]
    for i in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) + (card(rng, rng.randint(13, 19)) if i % 3 == 0 and i % 2 else "")
        assert P.detect(text) == brute(text), text


def test_base_spans_always_stay():
    rng = random.Random(6)
    pieces = ["@", ".", "-", "+", " ", " at ", " dot ", "one ", "a", "b1", "(at)", "[dot]", "com", "1", "O", "l2", "​", "＠", "а", "1.2.3.4", "4111111111111111", "+49 30 1234567", "double five ", "plus "]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        spans = P.find_spans(text)
        assert [s[:3] for s in spans if not s[3]] == brute(text), text
        assert all(0 <= a < z <= len(text) for _, a, z, _ in spans)


DISGUISED = [
    ("email", "john [at] example [dot] com"), ("email", "john(at)example(dot)com"), ("email", "john.smith at mail dot example dot org"),
    ("email", "john dot smith at example dot com"), ("email", "JOHN AT EXAMPLE DOT COM"), ("email", "john @ example . com"), ("email", "john@example dot com"),
    ("email", "john&#64;example.com"), ("email", "john%40example.com"), ("email", "john_at_example_dot_com"), ("email", "john{at}example.com"),
    ("email", "john＠example．com"), ("email", "jоhn@exаmple.com"), ("email", "j​ohn@example.com"), ("email", "john.smith7 at example.com"),
    ("email", "𝐣𝐨𝐡𝐧@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.com"), ("email", "juan arroba ejemplo punto es"), ("email", "max [at] beispiel [punkt] de"),
    ("ip", "192[.]168[.]1[.]17"), ("ip", "192 dot 168 dot 1 dot 17"), ("ip", "１９２．１６８．１．１７"), ("ip", "l92.168.O.17"), ("ip", "one nine two dot one six eight dot one dot one seven"),
    ("card", "４１１１１１１１１１１１１１１１"), ("card", "4111 1111 1111 1111".replace(" ", " ")), ("card", "four " + "one " * 14 + "one"), ("card", "4lll 1111 1111 1111"[:1] + "1l1 1111 1111 1111"),
    ("card", "4111 one one one one 1111 1111"), ("card", "vier " + "eins, " * 14 + "eins"), ("card", "four triple one " + "one " * 11 + "one"), ("card", "4111–1111–1111–1111"), ("card", "٤١١١١١١١١١١١١١١١"),
    ("phone", "+49 30 l234567"), ("phone", "＋49 30 1234567"), ("phone", "plus four nine three zero one two three four five six seven"), ("phone", "+1 (274) 555-9629"), ("phone", "plus 49 drei null 1234567"),
]


@pytest.mark.parametrize("kind,hidden", DISGUISED)
@pytest.mark.parametrize("around", [("", ""), ("Write to ", " today. Thanks"), ("é ï\n", "\nand more"), ("x: ", ", or call")])
def test_disguised_identifiers_map_back_to_their_characters(kind, hidden, around):
    text = around[0] + hidden + around[1]
    want = (P.KINDS.index(kind), len(around[0]), len(around[0]) + len(hidden), True)
    assert want in P.find_spans(text), P.find_spans(text)
    assert [s for s in P.find_spans(text) if s[3]] == [want]


CLEAN = [
    "Meet me at home. Then we go", "look at example.com for more", "She arrived at noon dot dot dot", "two plus two is four. one two three, go!", "Il faut un point de vue plus clair",
    "The price @ 3.50 is fine", "version 1.2.3 and 4.5", "at the end.Of the day", "почта и адрес. Привет", "one.two and three", "chapter four, five, six, seven and eight", "dos o tres veces, un punto final",
    "call at 10.30 or 11.45", "a (a) b (b) c", "he said: oh one", "IO error l0 O2", "ich bin um acht, neun oder zehn da", "<a> href </a> .", "nothing at all", "12 345 un an",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_are_left_alone(text):
    assert P.find_spans(text) == []
    assert P.find_spans(text + " john@example.com") == [(0, len(text) + 1, len(text) + 17, False)]


@pytest.mark.parametrize("piece", ["1", "a", "1.", "+1 ", "@", "a@", "a.", "1 ", "O", "one ", "at ", " ", "(", "dot ", "one dot ", "a at ", "@a.", "[at]", "1O", "_at_", "​"])
def test_very_long_texts_take_linear_time(piece):
    began = time.time()
    P.find_spans(piece * (200_000 // len(piece)))
    assert time.time() - began < 5


def test_rewritten_pieces_lead_back():
    r = P.Rewritten("abcXYdefZ!", [(3, 5, "12345"), (8, 9, "")])
    assert r.text == "abc12345def!"
    assert r.back(0, 3) == (0, 3, False) and r.back(2, 5) == (2, 5, True) and r.back(4, 6) == (3, 5, True)
    assert r.back(8, 11) == (5, 8, False) and r.back(8, 12) == (5, 10, True) and r.back(11, 12) == (9, 10, False)


def test_awkward_rows_and_the_report(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()] + [(900, "a@b.co 1.2.3.4 john (at) x (dot) org é 4111 1111 1111 1111 +49 30 1234567"), (None, "a@b.co"), (900, "x" * 100_000 + "@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in P.report(P.personal_data(df)).collect()), key=str)
    want = []
    for i, t in rows:
        base = brute(t)
        form = lambda s: ",".join(f"{P.KINDS[k]}:{a}:{z}" for k, a, z in s)
        every = P.find_spans(t)
        want.append((i, *[sum(k == x for x, *_ in base) for k in range(4)], sha256(form(base).encode()).hexdigest(), form([s[:3] for s in every]), len(every) - len(base)))
    assert got == sorted(want, key=str)
    assert sum(r[7] for r in got) == 1
    assert P.report(P.personal_data(awkward(spark))).columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_empty_table(spark):
    assert P.report(P.personal_data(empty(spark))).collect() == []
