"""Variant spellings of names typed by people (problem 4).

Strings are joined by the pigeonhole principle: a string with at most k edits keeps one of its k + 1 segments whole, so
each indexed string is cut into k + 1 segments, the other side looks up its substrings at shifted positions, and a
banded edit distance verifies what meets. Persons meet within nationality, university and year of graduation; facility names
meet on their distinguishing words, in either order, and are then held against the kind of facility.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.lineage import written

# Words beside a name, and short forms of given names with the full form.
HONOURS = frozenset("dr doctor prof professor mr mrs ms miss md phd mbbs bds rn gp dds msc bsc facs frcs mrcp".split())
PARTICLES = frozenset("al el bin ibn bint abu de da del la le van von der den dos ul ur".split())
NICKNAMES = dict(
    x.split(":")
    for x in """
abdul:abdullah abdulla:abdullah abdallah:abdullah ahmad:ahmed ahmet:ahmed alex:alexander sasha:alexander sandy:alexander xander:alexander bernie:bernadette
charlie:charlotte lottie:charlotte deepa:deepika dipika:deepika beth:elizabeth liz:elizabeth lizzie:elizabeth eliza:elizabeth
betty:elizabeth elisabeth:elizabeth manny:emmanuel manuel:emmanuel emanuel:emmanuel fatma:fatima fathima:fatima gabi:gabriela gaby:gabriela
husayn:hussein hussain:hussein hossein:hussein ebrahim:ibrahim abraham:ibrahim quino:joaquin joaquim:joaquin kate:katherine kathy:katherine
katie:katherine kat:katherine cathy:katherine catherine:katherine khadeeja:khadija khadijah:khadija lucy:lucia luzia:lucia luz:lucia maggie:margaret meg:margaret
peggy:margaret greta:margaret mohd:mohammed muhammad:mohammed mohamed:mohammed nick:nicholas nico:nicholas
umar:omar omer:omar priya:priyanka raj:rajesh rob:robert bob:robert bobby:robert bert:robert robbie:robert sanju:sanjana
ted:theodore theo:theodore teddy:theodore vicky:victoria vicki:victoria tori:victoria bill:william will:william billy:william liam:william willy:william
wolf:wolfgang yusuf:yousef youssef:yousef yousuf:yousef josef:joseph joe:joseph zaynab:zainab zeinab:zainab tom:thomas jim:james dick:richard
mike:michael dave:david dan:daniel sam:samuel tony:anthony chris:christopher steve:stephen ed:edward jen:jennifer sue:susan pat:patricia
""".split()
)
# Words of facility kinds with the short forms that stand for them, and words that tell nothing apart.
KIND_FORMS = {
    "centre": "center centers ctr cen cent",
    "clinic": "clinics clin cl",
    "pharmacy": "pharm phar pharmacies phy",
    "hospital": "hosp hospitals",
    "optical": "opt optic opticals",
    "polyclinic": "poly polyclinics",
    "medical": "med medi",
    "dental": "dent",
    "diagnostic": "diag diagn diagnostics",
    "physiotherapy": "physio phys",
    "surgery": "surg surgical",
    "day": "",
    "home": "",
    "healthcare": "health care",
    "laboratory": "lab labs laboratories",
    "nursing": "nurs",
}
EMPTY_WORDS = frozenset("the and of others other branch br bldg building main floor dept department c o co company llc fz fzllc fzco est inc ltd limited group new at in no ground first second third nd st rd th unit suite".split())

_FORM = {form: kind for kind, forms in KIND_FORMS.items() for form in [kind, *forms.split()]}
_GLUED = re.compile("daysurgerycentre|daysurgery|medicalcentre|diagnosticcentre|physiotherapycentre|homehealthcare|homehealth|dentalclinic|polyclinic|pharmacy|hospital|optical|healthcare|physiotherapy|diagnostic")
_GLUED_KINDS = {
    "daysurgerycentre": "day surgery centre", "daysurgery": "day surgery", "medicalcentre": "medical centre", "diagnosticcentre": "diagnostic centre", "physiotherapycentre": "physiotherapy centre",
    "homehealthcare": "home healthcare", "homehealth": "home healthcare", "dentalclinic": "dental clinic",
}


def folded(text: str) -> str:
    """Lower case without accents; compatibility forms as plain letters."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def edit_distance(a: str, b: str, k: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours that lead from a to b, or k + 1 if they are more than k; only the band of k about the diagonal is filled."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > k:
        return k + 1
    far = k + 1
    if k == 0:
        return far
    # What both begin and end with needs no edit.
    i, short = 0, min(len(a), len(b))
    while i < short and a[i] == b[i]:
        i += 1
    j = 0
    while j < short - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    n, m = len(a), len(b)
    if n <= 1 and m <= 1 or n == m == 2 and a == b[::-1]:
        return 1
    if k == 1:
        return far
    if not n or not m:
        return max(n, m)
    before: list[int] = []
    row = [j if j <= k else far for j in range(m + 1)]
    for i in range(1, n + 1):
        lo, hi = max(1, i - k), min(m, i + k)
        new = [far] * (m + 1)
        if i <= k:
            new[0] = i
        x = a[i - 1]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            d = row[j - 1] + (x != y)
            if row[j] + 1 < d:
                d = row[j] + 1
            if new[j - 1] + 1 < d:
                d = new[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            new[j] = d
        if min(new) > k:
            return far
        before, row = row, new
    return min(row[m], far)


def cuts(length: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 nearly equal segments."""
    base, more = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - more)
        out.append((at, size))
        at += size
    return out


#: From which lengths on one, two, three edits are allowed: within small blocks, and for strings that meet all others.
WIDE, NARROW = (4, 7, 14), (4, 9, 14)
#: Strings that may share a segment before it is no longer a key alone.
HOT = 64


def edits_for(length: int, steps: tuple[int, ...]) -> int:
    """Edits allowed in a string of this length."""
    return sum(length >= x for x in steps)


def indexed(s: str, k: int) -> list[tuple[str, int, str]]:
    """The segments by which s is found within k edits: (segment, tag, rest); the tag says length and segment number, the rest is s without the segment.

    A swap of neighbours across a border counts as an edit of the segment before it, so the segment behind is indexed with its first letter
    swapped as well.
    """
    at = cuts(len(s), k)
    out = [(s[p : p + g], len(s) * 8 + i, s[:p] + s[p + g :]) for i, (p, g) in enumerate(at)]
    for i, (p, g) in enumerate(at[1:], 1):
        if g and p:
            v = s[: p - 1] + s[p] + s[p - 1] + s[p + 1 :]
            out.append((v[p : p + g], len(s) * 8 + i, v[:p] + v[p + g :]))
    return list(dict.fromkeys(out))


def looked_up(s: str, length: int, k: int) -> list[tuple[str, int, str]]:
    """All (substring, tag, rest) under which a string of that length within k edits of s must be found.

    Of k + 1 segments there is a first one, number i, with no edit in it, exactly i edits before it and so at most k - i behind it: it is shifted by at most
    i places, and the rest of the difference in length lies behind it.
    """
    n, out = len(s), []
    for i, (p, g) in enumerate(cuts(length, k)):
        for shift in range(-i, i + 1):
            q = p + shift
            if abs(n - length - shift) <= k - i and 0 <= q <= n - g:
                out.append((s[q : q + g], length * 8 + i, s[:q] + s[q + g :]))
    return list(dict.fromkeys(out))


def _pieces(df: DataFrame, keep: list[str], steps: tuple[int, ...], index: bool, longer: bool) -> DataFrame:
    """The kept columns, s, piece, tag and rest; without index for every length that is in reach (with longer: no less than the string's own)."""
    source = df.select(*keep, "s")

    def one(s: str) -> list[tuple[str, int, str]]:
        if index:
            return indexed(s, edits_for(len(s), steps))
        n = len(s)
        reach = [(m, edits_for(m, steps)) for m in range(n if longer else max(1, n - len(steps)), n + len(steps) + 1)]
        return [x for m, k in reach if abs(n - m) <= k for x in looked_up(s, m, k)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seg, tag, rest = [], [], [], []
            for i, s in enumerate(batch.column(len(keep)).to_pylist()):
                for piece, t, r in one(s) if s else ():
                    rows.append(i)
                    seg.append(piece)
                    tag.append(t)
                    rest.append(r)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(len(keep) + 1)], pa.array(seg, pa.string()), pa.array(tag, pa.int32()), pa.array(rest, pa.string())], names=[*keep, "s", "piece", "tag", "rest"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[: len(keep)])
    return source.mapInArrow(cut, f"{schema}s string, piece string, tag int, rest string")


def _again(df: DataFrame, keep: list[str], steps: tuple[int, ...], index: bool) -> DataFrame:
    """Cuts the rests of pieces once more: the kept columns, s, piece, tag, and piece2, tag2 of the rest."""
    source = df.select(*keep, "s", "piece", "tag", "rest")
    n = len(keep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seg, tag = [], [], []
            for i, (piece, t, rest) in enumerate(zip(*[batch.column(n + j).to_pylist() for j in (1, 2, 3)])):
                k = edits_for(t // 8, steps)
                for x in indexed(rest, k) if index else looked_up(rest, t // 8 - len(piece), k):
                    rows.append(i)
                    seg.append(x[0])
                    tag.append(x[1])
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(n + 3)], pa.array(seg, pa.string()), pa.array(tag, pa.int32())], names=[*keep, "s", "piece", "tag", "piece2", "tag2"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:n])
    return source.mapInArrow(cut, f"{schema}s string, piece string, tag int, piece2 string, tag2 int")


def segment_join(left: DataFrame, right: DataFrame, block: list[str], *, steps: tuple[int, ...] = WIDE, longer: bool = False, hot: int = HOT) -> DataFrame:
    """Distinct (block..., l, r, distance) of strings within the edits allowed for the right one's length.

    left, right: the block columns and `s`, of which distinct rows are taken. Blocks compare by equality, and a NULL block or string
    meets nothing. With `longer` only right strings at least as long as the left are looked for, which halves the work of joining a table with
    itself, and equal strings are left out, as they meet by a plain join. The join is one equi-join on block, segment, length and segment number. A segment that more than `hot` strings of a block share is never a key
    alone: what is left of both strings without it must agree within the same edits, so it is cut once more by the same rule. Pairs are
    verified in the JVM (a swap is two plain edits) before they are made distinct, and what is left by the banded distance.
    """
    key = [*block, "piece", "tag"]
    a = _pieces(left.select(*block, "s").distinct(), block, steps, False, longer)
    b = written(_pieces(right.select(*block, "s").distinct(), block, steps, True, longer), "segments")
    often = b.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(*key)
    allowed = reduce(lambda x, y: x + y, [(F.length("r") >= n).cast("int") for n in steps])
    close = (F.abs(F.length("l") - F.length("r")) <= allowed) & (F.levenshtein("l", "r") <= 2 * allowed)
    close = close & (F.col("l") != F.col("r")) if longer else close
    often = written(often, "often")
    if often.isEmpty():
        met = a.join(b.withColumnRenamed("s", "r").drop("rest"), key).select(*block, F.col("s").alias("l"), "r").where(close)
    else:
        a = written(a, "lookups")
        once = a.join(b.join(often, key, "left_anti").withColumnRenamed("s", "r").drop("rest"), key)
        twice = _again(a.join(often, key, "left_semi"), block, steps, False).join(_again(b.join(often, key, "left_semi"), block, steps, True).withColumnRenamed("s", "r"), [*key, "piece2", "tag2"])
        met = once.select(*block, F.col("s").alias("l"), "r").where(close).union(twice.select(*block, F.col("s").alias("l"), "r").where(close))
    met = met.distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ls, rs = batch.column(len(block)).to_pylist(), batch.column(len(block) + 1).to_pylist()
            k = [edits_for(len(r), steps) for r in rs]
            d = [edit_distance(x, y, z) for x, y, z in zip(ls, rs, k)]
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.int32())], names=[*batch.schema.names, "distance"])
            yield out.filter(pa.array([x <= z for x, z in zip(d, k)], pa.bool_()))

    schema = "".join(f"`{c}` {met.schema[c].dataType.simpleString()}, " for c in block)
    return met.mapInArrow(verify, f"{schema}l string, r string, distance int")


def name_tokens(name: str | None, particles: bool = False) -> list[str]:
    """Words of a person's name in order, without honours and (unless asked for) particles."""
    if not name:
        return []
    words = re.findall(r"[^\W\d_]+", folded(re.sub(r"\([^)]*\)", " ", name)).replace("'", ""))
    return [w for w in words if w not in HONOURS and (particles or w not in PARTICLES)]


#: What a string that a person is found by is made of.
OUTER, WHOLE, JOINED = 0, 1, 2


def token_strings(name: str | None) -> dict[str, int]:
    """What a person is found by: the outer words (any may be the family name), the whole name as one word, and the outer neighbours written as one."""
    out: dict[str, int] = {}
    both = [t for t in (name_tokens(name), name_tokens(name, True)) if t]
    for kind, parts in ((OUTER, lambda t: (t[0], t[-1])), (WHOLE, lambda t: ("".join(t),)), (JOINED, lambda t: ("".join(t[:2]), "".join(t[-2:])))):
        for t in both:
            for w in parts(t):
                out.setdefault(w, kind)
    return {w: kind for w, kind in out.items() if len(w) > 1}


def _given(x: str, y: str) -> bool:
    if len(x) == 1 or len(y) == 1:
        return x[0] == y[0] or NICKNAMES.get(x, x)[0] == NICKNAMES.get(y, y)[0]
    a, b = NICKNAMES.get(x, x), NICKNAMES.get(y, y)
    if a == b:
        return True
    return edit_distance(a, b, 2) <= (1 if min(len(a), len(b)) < 5 else 2)


def _in_order(a: list[str], b: list[str]) -> bool:
    """Given names agree: the first ones do, and the rest of the shorter list is found in order in the longer."""
    if not a or not b:
        return not a and not b
    if not _given(a[0], b[0]):
        return False
    short, long = sorted((a[1:], b[1:]), key=len)
    at = 0
    for x in short:
        while at < len(long) and not _given(x, long[at]):
            at += 1
        if at == len(long):
            return False
        at += 1
    return True


def _merged(t: list[str]) -> list[list[str]]:
    return [t] + [t[:i] + [t[i] + t[i + 1]] + t[i + 2 :] for i in range(len(t) - 1)]


def one_person(a: str | None, b: str | None) -> bool:
    """Whether two names are spellings of one name: a family name alike, wherever it stands, and given names that do not contradict."""
    ta, tb = name_tokens(a), name_tokens(b)
    if not ta or not tb:
        return False
    pa_, pb = name_tokens(a, True), name_tokens(b, True)
    for x in dict.fromkeys(("".join(ta), "".join(pa_))):
        for y in dict.fromkeys(("".join(tb), "".join(pb))):
            k = edits_for(min(len(x), len(y)), WIDE[:2])
            if edit_distance(x, y, k) <= k:
                return True
    for x in _merged(ta) + (_merged(pa_)[1:] if pa_ != ta else []):
        for y in _merged(tb) + (_merged(pb)[1:] if pb != tb else []):
            for i in {0, len(x) - 1}:
                for j in {0, len(y) - 1}:
                    short = min(len(x[i]), len(y[j]))
                    if short < 2 or len(x) < 2 or len(y) < 2:
                        continue
                    k = 0 if short < 4 else 1 if short < 6 else 2
                    if edit_distance(x[i], y[j], k) <= k and _in_order(x[:i] + x[i + 1 :], y[:j] + y[j + 1 :]):
                        return True
    return False


def person_pairs(doctors: DataFrame, key: str, name: str, block: list[Column]) -> DataFrame:
    """(key_a, key_b), the lesser key first, of rows of one block whose names are spellings of one name.

    A row with a NULL in its block, or without a word of two letters in its name, is paired with nothing. Repeated rows count once; rows of equal
    names are paired, and a key may stand in several blocks. Words below four letters are found as they are, longer ones within their edits; no
    length is left out. Other columns are not read.
    """
    blocks = [f"b{i}" for i in range(len(block))]
    base = doctors.select(F.col(key).alias("id"), F.col(name).alias("name"), *[c.alias(b) for b, c in zip(blocks, block)]).where("id IS NOT NULL AND name IS NOT NULL").dropna(subset=blocks).distinct()
    base = base.withColumn("whole", F.concat_ws("\x01", *blocks)).select("id", "name", "whole", F.xxhash64("whole").alias("block"))
    shared = base.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block")
    base = written(base.join(shared, "block"), "persons")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = [token_strings(n) for n in batch.column(1).to_pylist()]
            take = pa.array([i for i, m in enumerate(many) for _ in m], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array([s for m in many for s in m], pa.string()), pa.array([j for m in many for j in m.values()], pa.int32())], names=["id", "block", "s", "kind"])

    words = written(base.select("id", "name", "block").mapInArrow(strings, "id string, block long, s string, kind int"), "words")
    plain, outer = words.where(F.col("kind") != JOINED), words.where(F.col("kind") == OUTER)
    # Neighbours written as one can only be a word of another name: they are looked up where the block has a word that long.
    longest = outer.groupBy("block").agg(F.max(F.length("s")).alias("most"))
    joined = words.where(F.col("kind") == JOINED).join(longest, "block").where(F.length("s") - len(WIDE[:2]) <= F.col("most"))
    alike = segment_join(plain, plain, ["block"], steps=WIDE[:2], longer=True).union(segment_join(joined, outer, ["block"], steps=WIDE[:2]).where("l <> r"))
    alike = written(alike, "alike")
    a = words.select("block", F.col("s").alias("l"), F.col("id").alias("key_a"))
    b = words.select("block", F.col("s").alias("r"), F.col("id").alias("key_b"))
    pair = [F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")]
    met = alike.join(a, ["block", "l"]).join(b, ["block", "r"]).where("key_a <> key_b").select(*pair)
    same = a.withColumnRenamed("l", "s").join(b.withColumnRenamed("r", "s"), ["block", "s"]).where("key_a < key_b").select("key_a", "key_b")
    met = met.union(same).distinct()
    # Blocks met by a hash; here they are compared as they are.
    both = met.join(base.select(F.col("id").alias("key_a"), F.col("name").alias("na"), "whole"), "key_a").join(base.select(F.col("id").alias("key_b"), F.col("name").alias("nb"), "whole"), ["key_b", "whole"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [one_person(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.select("key_a", "key_b", "na", "nb").mapInArrow(verify, "key_a string, key_b string").distinct()


def _shortened(word: str, kind: str) -> bool:
    """Whether the word is the kind with letters left out: the same first and last letter, and half of the letters at least, in order."""
    if len(word) < 3 or 2 * len(word) < len(kind) or word[0] != kind[0] or word[-1] != kind[-1]:
        return False
    letters = iter(kind)
    return all(c in letters for c in word)


@lru_cache(maxsize=65_536)
def _kind_of(word: str) -> str | None:
    """The kind a word stands for: written out or in a usual short form, cut off, with letters left out, or mistyped."""
    if word in _FORM:
        return _FORM[word]
    for form, kind in _FORM.items():
        if len(form) >= 4 and (len(word) >= 4 and form.startswith(word) or _shortened(word, form)):
            return kind
    if len(word) >= 5:
        for form, kind in _FORM.items():
            k = 1 if len(form) < 8 else 2
            if len(form) >= 5 and edit_distance(word, form, k) <= k:
                return kind
    return None


def facility_parts(text: str) -> tuple[list[str], list[str]]:
    """(words, kinds): the words that tell a facility from others, and the sorted words of its kind."""
    t = text.replace("_", " ")
    if re.search(r"\b[a-z][A-Z]{3}", t):
        t = t.swapcase()
    if re.search(r"\S{12}", t):  # words run together: cut where the case changes
        t = re.sub(r"(?<=[a-z])(?=[A-Z][A-Za-z.])", " ", t)
    t = folded(t)
    t = re.sub(r"\b(dept|department)\.? ?of ?\w+", " ", t)
    t = re.sub(r"\bc ?/ ?o(?=\W|[a-z]{5})|&|\(?\bmain ?bldg\b\)?|\b\d+(st|nd|rd|th) ?floor\b", " ", t)
    t = re.sub(r"[\W_]*\bl[\W_]*l[\W_]*c\b|l\.l\.c|\bfz\b|(?<=ctr|tre|ter)llc\b", " ", t)
    t = re.sub(r"\bpoly[\W_]*clinic", "polyclinic", t)
    t = re.sub(r"\bhome[\W_]*health[\W_]*care\b", "home healthcare", t)
    raw = re.findall(r"[^\W_]+", t)
    joined: list[str] = []
    at = 0
    while at < len(raw):  # letters typed with blanks between them are one word
        end = at
        while end < len(raw) and len(raw[end]) == 1:
            end += 1
        joined += ["".join(raw[at:end])] if end - at >= 3 else raw[at : max(end, at + 1)]
        at = max(end, at + 1)
    raw = joined
    words, kinds = [], []
    for at, w in enumerate(raw):
        if at == len(raw) - 1 and kinds and any(k.startswith(w) for k in KIND_FORMS):  # a name cut off within a word of its kind
            kinds += [_FORM[w]] if w in _FORM else []
            continue
        if w in EMPTY_WORDS or w.isdigit():
            continue
        kind = _kind_of(w)
        if kind:
            kinds.append(kind)
            continue
        if len(w) >= 10:
            for suffix in ("fzllc", "llc", "co", "branch", "br"):
                if w.endswith(suffix) and len(w) - len(suffix) >= 10:
                    w = w[: -len(suffix)]
            hit = _GLUED.search(w)
            if hit:
                kinds += _GLUED_KINDS.get(hit.group(), hit.group()).split()
                rest = [w[: hit.start()], w[hit.end() :]]
                rest[1] = re.sub(r"^(fzllc|llc|co)(?=.{4})", "", rest[1])
                words += [r for r in rest if r and r not in EMPTY_WORDS and r not in ("fzllc", "llc", "co")]
                continue
            for end in ("day", "medical", "dental", "home", "centre", "clinic"):
                if w.endswith(end) and len(w) - len(end) >= 5:
                    kinds.append(end)
                    w = w[: -len(end)]
                    break
        words.append(w)
    return words, sorted(set(kinds))


def _orders(words: list[str]) -> list[str]:
    """The words as one string, in every rotation."""
    return list(dict.fromkeys("".join(words[i:] + words[:i]) for i in range(max(1, len(words)))))


def _parsed(df: DataFrame, keep: list[str], text: str, orders: bool) -> DataFrame:
    source = df.select(*keep, F.col(text).alias("__t"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, strings, kinds = [], [], []
            for i, t in enumerate(batch.column(len(keep)).to_pylist()):
                words, kind = facility_parts(t or "")
                for s in _orders(words) if orders else ["".join(words)]:
                    if s:
                        rows.append(i)
                        strings.append(s)
                        kinds.append(" ".join(kind))
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(len(keep))], pa.array(strings, pa.string()), pa.array(kinds, pa.string())], names=[*keep, "s", "kinds"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    return source.mapInArrow(parse, f"{schema}, s string, kinds string")


def facility_links(doctors: DataFrame, facilities: DataFrame) -> DataFrame:
    """(key_a, key_b): doctor id and the id of the facility whose name doctor.facility is another spelling of.

    A text equal to a listed name, or NULL, blank or without a distinguishing word, is no case. The distinguishing words must
    all be there, in any order, within the edits their length allows; the words of the kind that the text still has must be among the
    facility's. The nearest facility wins (fewest edits, then most words of the kind); a draw between facilities names none.
    """
    listed = facilities.select(F.col("id").alias("fid"), F.col("nameTrimmed").alias("listed")).where("fid IS NOT NULL AND listed IS NOT NULL").distinct()
    doc = doctors.select("id", F.col("facility").alias("text")).where("id IS NOT NULL AND trim(text) <> ''").distinct()
    texts = doc.select("text").distinct().join(listed.select(F.col("listed").alias("text")), "text", "left_anti")
    # Whatever words of the kind a text has must be the facility's, so a text meets only facilities that have a certain one of them.
    own = F.split("kinds", " ")
    telling = F.filter(own, lambda x: ~x.isin("centre", "clinic", "day", "home"))
    t = written(_parsed(texts, ["text"], "text", False).withColumn("block", F.coalesce(F.get(telling, F.lit(0)), F.get(own, F.lit(0)), F.lit(""))), "texts")
    f = written(_parsed(listed, ["fid"], "listed", True), "facilities")
    alike = written(segment_join(t, f.select("s", F.explode(F.array_union(own, F.array(F.lit("")))).alias("block")), ["block"], steps=NARROW), "alike")
    met = alike.join(t.withColumnRenamed("s", "l").withColumnRenamed("kinds", "kt"), ["block", "l"]).join(f.withColumnRenamed("s", "r").withColumnRenamed("kinds", "kf"), "r")
    want, have = F.split("kf", " "), F.filter(F.split("kt", " "), lambda x: x != "")
    met = met.where(F.size(F.array_except(have, want)) == 0).select("text", "fid", F.struct(F.col("distance"), (F.size(want) - F.size(have)).alias("lost")).alias("rank"))
    best = met.groupBy("text", "fid").agg(F.min("rank").alias("rank"))
    top = best.groupBy("text").agg(F.min("rank").alias("rank"))
    sole = best.join(top, ["text", "rank"]).groupBy("text").agg(F.min("fid").alias("fid"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return doc.join(sole, "text").select(F.col("id").alias("key_a"), F.col("fid").alias("key_b")).distinct()
