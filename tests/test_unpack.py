import random
import re

import pyarrow as pa
from ledgerline.operators.unpack import LANGUAGES, SPECIALITIES, split_array, unpacked


def brute(text, marks, words):
    """One character after another; double quotes only."""
    if text is None:
        return []
    if text.count('"') % 2:
        cut = text.rindex('"')
        text = text[:cut] + "\0" + text[cut + 1 :]
    out, cur, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            quoted = not quoted
        if not quoted:
            hit = next((m for m in marks if text.startswith(m, i)), None)
            if hit is None:
                for w in words:
                    if text[i : i + len(w)].lower() == w and (i == 0 or text[i - 1] in ' \t\n"') and (i + len(w) == len(text) or text[i + len(w)] in ' \t\n"'):
                        hit = text[i : i + len(w)]
            if hit is not None:
                out.append(cur)
                cur, i = "", i + len(hit)
                continue
        cur += c
        i += 1
    items = []
    for x in [*out, cur]:
        x = x.strip()
        if re.fullmatch(r'"(?:[^"]|"")*"', x):
            x = x[1:-1].replace('""', '"').strip()
        if x:
            items.append(x.replace("\0", '"'))
    return items


def test_against_brute_force():
    rnd = random.Random(7)
    parts = ["ab", "é", "c d", '"', '""', ",", ";", "|", " and ", "and", " ", "\t", "//", "/", "&", "x", "و", "،", '"q, r"', " - ", ""]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(4000)] + [None]
    texts = [t and re.sub("/{3,}", "//", t) for t in texts]
    spec = split_array(pa.array(texts, pa.string()), SPECIALITIES).to_pylist()
    for t, got in zip(texts, spec):
        assert got == brute(t, ("|", ";", "\t", "\n", "\r", "//"), ()), t
    plain = [t for t in texts if t is None or " - " not in t]
    marks = (",", ";", "|", "/", "+", "&", "\t", "\n", "\r", "،")
    for t, got in zip(plain, split_array(pa.array(plain, pa.string()), LANGUAGES).to_pylist()):
        assert got == brute(t, marks, ("and",)), t


def test_forms():
    cases = {
        '"English"; "Portuguese; Brazil"; Tamil': ["English", "Portuguese; Brazil", "Tamil"],
        'English and "Kurdish/Sorani" AND Urdu': ["English", "Kurdish/Sorani", "Urdu"],
        '["English", "Sign, Language"]': ["English", "Sign, Language"],
        "English - 'Swahili & Dialects' - Serbo-Croatian": ["English", "Swahili & Dialects", "Serbo-Croatian"],
        "O'Neil; 'a, b'": ["O'Neil", "a, b"],
        ",, English ,, English": ["English", "English"],
        "[]": [],
        '""': [],
        "   ": [],
        'x "a b': ['x "a b'],
        "Islands and Portland, and": ["Islands", "Portland"],
    }
    assert split_array(pa.array(list(cases)), LANGUAGES).to_pylist() == list(cases.values())
    spec = {
        '"Nurse ""On Call"" Active · X";A, b & c and d / e // f': ['Nurse "On Call" Active · X', "A, b & c and d / e", "f"],
        '["Nurse \\"On Call\\" · G", "b\\u00e9, c"]': ['Nurse "On Call" · G', "bé, c"],
        '"X-ray | Ultrasound Active"|q |': ["X-ray | Ultrasound Active", "q"],
    }
    assert split_array(pa.array(list(spec)), SPECIALITIES).to_pylist() == list(spec.values())
    long = "; ".join(f"item {i}" for i in range(50_000))
    assert len(split_array(pa.array([None, long, "a"]), SPECIALITIES)[1]) == 50_000
    assert split_array(pa.array(["zz", "a;b", None, "c"])[1:], SPECIALITIES).to_pylist() == [["a", "b"], [], ["c"]]
    assert split_array(pa.array([], pa.string()), SPECIALITIES).to_pylist() == []


def test_frame(spark):
    df = spark.createDataFrame([("1", "a, b", None, "x"), ("2", None, "c | d", "y"), ("1", "a, b", None, "x")], "id string, l string, s string, item string")
    out = unpacked(df, ["id"], {"l": LANGUAGES, "s": SPECIALITIES})
    assert sorted(map(tuple, out.collect())) == sorted([("1", "l", 1, "a"), ("1", "l", 2, "b")] * 2 + [("2", "s", 1, "c"), ("2", "s", 2, "d")])
    assert unpacked(df.limit(0), ["id"], {"l": LANGUAGES}).count() == 0


def test_single_quotes_beside_line_breaks_and_tabs():
    cases = {
        "French / Arabic\n'Punjabi, Western';Farsi (Persian)": ["French", "Arabic", "Punjabi, Western", "Farsi (Persian)"],
        "English\n'Portuguese; Brazil'": ["English", "Portuguese; Brazil"],
        "A\t'Sign Language | Local' ;": ["A", "Sign Language | Local"],
        "'X, Y'\r\nB": ["X, Y", "B"],
        "O'Neill, D'Arcy": ["O'Neill", "D'Arcy"],
    }
    assert split_array(pa.array(list(cases)), LANGUAGES).to_pylist() == list(cases.values())


def test_escapes_of_many_list_items():
    texts = ['["a\\"b", "c\\u0041", "d\\\\"]'] * 3
    assert split_array(pa.array(texts), LANGUAGES).to_pylist() == [['a"b', "cA", "d\\"]] * 3
