"""Personal data: what is found, what isn't, and that masks can be undone."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from memloom.llm import personal as P

FOUND = [
    ("write to nadia.vermere@mail.example now", {"email"}), ("my mail is ravi76 at inbox dot test", {"email"}), ("kofi_x [at] uni [dot] example", {"email"}), ("c (at) post.example", {"email"}),
    ("call me on (273) 555-0136", {"phone"}), ("ring +44 20 7946 0600", {"phone"}), ("text 555 0138 after work", {"phone"}), ("07700 900190", {"phone"}), ("5145550177", {"phone"}), ("five five five zero one three two", {"phone"}),
    ("+1 (336) 555 0176 ext. 12", {"phone"}), ("my SSN is 947-43-4111", {"id_number"}), ("the social security no., 913750243", {"id_number"}), ("use 937209155 as the social security no.", {"id_number"}), ("QQ 18 50 77 B", {"id_number"}),
    ("with passport number ZZ1664106", {"id_number"}), ("DL-2305-4935-97", {"id_number"}), ("585296-7071", {"id_number"}), ("73.86.97-373.92", {"id_number"}), ("tax id 437 979 177 9", {"id_number"}),
    ("I live at 283a Kiln Crescent, Lowmere 21952", {"address"}), ("163 windlass st.", {"address"}), ("89 WEAVER DRIVE", {"address"}), ("Foxgloveweg 32, 96744 Tarnmouth", {"address"}), ("rue de la Slate 289", {"address"}),
    ("I spoke with Pavel Haldgrove-Ostergrove", {"name"}), ("this is L. Bramvorn", {"name"}), ("Ms Stanvorn agreed", {"name"}), ("the manager, Bramovan, Aisha, agreed", {"name"}), ("ravi pemhaven called", {"name"}), ("by HUGO PEMVORN", {"name"}),
    ("Wei Zhang met us at noon", {"name"}), ("I still have Adaeze Okonkwo's email", {"name"}), ("yesterday Jun-Ho Lim said no", {"name"}),
]
CLEAN = [
    "invoice 439166247 dated 2025-05-10 was paid", "order 4438-36-8872 is still open", "build 10.32.42.4 failed on 192.0.2.241", "use the @insulin handle or the market@4.7 package", "the mail server said 550 5.1.7 and closed port 7594",
    "chapter 3 covers lane markings and road signs", "set the timeout to 924 300 4819 microseconds", "part no. L4373972 fits the pantry", "score was 963-43 after 3870 rounds", "swim in lane 3 of the terrace and leave by gate 14",
    "Every May met expectations", "Team Korfroanto said yes", "The Committee told us", "North Pier works best", "social security is a long topic", "my name is not on the list", "ask for extra napkins at the door", "budget: 92099 credits; place: windy", "", " ", None,
]


@pytest.mark.parametrize(("text", "kinds"), FOUND)
def test_found(text, kinds):
    assert {k for _, _, k in P.find(text)} == kinds


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert P.find(text) == []


@given(st.integers(2, 18).flatmap(lambda n: st.text("0123456789", min_size=n, max_size=n)))
def test_digits_permute(digits):
    p = P.Pseudonyms(b"k")
    out = p.digits(digits)
    assert len(out) == len(digits) and out.isdigit() and p.digits(out, True) == digits


def test_permutation_and_dates():
    p = P.Pseudonyms(b"k")
    assert len({p.digits(f"{i:03}") for i in range(1000)}) == 1000
    for s in ("000101", "991231", "240229", "250229", "581345"):
        assert p.day(p.day(s), True) == s
    for s in ("850713-1234", "850713+0000", "73.86.97-373.92", "85.07.30-033.28", "943 476 5919", "943 476 591 9", "+1 (336) 555 0176"):
        assert p.number(s) != s and p.number(p.number(s), True) == s


def test_check_digits_stay_right_or_wrong():
    p = P.Pseudonyms(b"k")
    assert (P._luhn("811228987"), 97 - 850730033 % 97) == (4, 28)
    luhn, mod97, mod11 = (f.check for f in P._CHECKED)
    assert mod11("943476591") == 9
    for k in range(50):
        body = f"{70 + k % 9:02}0{1 + k % 9}1{k % 9}{100 + k}"
        new = p.number(f"{body[:6]}-{body[6:]}{luhn(body)}").replace("-", "")
        assert int(new[-1]) == luhn(new[:-1]) and 1 <= int(new[2:4]) <= 12
        wrong = p.number(f"{body[:6]}-{body[6:]}{(luhn(body) + 3) % 10}").replace("-", "")
        assert (int(wrong[-1]) - luhn(wrong[:-1])) % 10 == 3
        old = f"{body[:2]}.{body[2:4]}.{body[4:6]}-{body[6:]}.{mod97(body):02}"
        assert int((new := p.number(old).translate({46: None, 45: None}))[-2:]) == mod97(new[:-2])


def test_masks(spark):
    p = P.Pseudonyms(b"k")
    text = "Hi, ring (273) 555-0136 or mail a.b@c.example!"
    out = P.mask(text, p)
    assert out.startswith("Hi, ring [PHONE (") and out.endswith("!") and "555-0136" not in out and "a.b@" not in out
    assert P.mask(text, p) == out and P.mask(None, p) is None and P.mask("plain", p) == "plain"
    df = spark.createDataFrame([("1", text, "x"), ("1", text, "x"), ("2", None, "y"), (None, "Ms Stanvorn", "z"), ("3", "x" * 200_000, "k")], "id string, text string, kind string")
    assert sorted(P.report(df, ["id"], "text").collect(), key=str) == sorted([("1", "phone"), ("1", "email"), (None, "name")], key=str)
    assert [r.text for r in P.masked(df, "text", b"k").collect()][0] == out
    assert P.report(df.limit(0), ["id"], "text").count() == 0
