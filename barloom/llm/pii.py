"""Personal data: fixed patterns, and a conditional random field over word shapes.

The patterns give the base spans.  The field adds spans of names after cues,
secrets and account numbers.  It is trained on a small labelled table: the lines
below, some with slots that a seeded generator fills, so that it learns shapes
and surroundings and not the values.  It decodes whole texts, line by line, with
Viterbi in numpy batches.  Words are scored once per distinct word and worker;
their features come from the whole word, however long.
"""

from __future__ import annotations

import bisect
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, beside, freed, schema_with, table, text_slices
from .crf import Crf, feature

# Fixed patterns of the base spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # numbers with a dot between; four of a row, from the left, are one ip match
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ["email", "ip", "card", "phone"]
ADDED = ["name", "secret", "account"]
LABELS = ["O"] + [f"{p}-{k}" for k in ADDED for p in "BI"]

#: The labelled table.  A slot {kind} is a span of that kind and filled several times; all else is no span.
LABELLED = """\
My name is {name} and I live in the old town.
Please contact {name} for the details of this offer.
Contact: {name}, sales office, second floor.
Dear Mr. {name}, thank you for the letter.
Dear Mrs. {name} we have received your order.
Dear {name},
Yours sincerely, {name}
Kind regards, {name}
Signed by Dr. {name} on the last page.
The patient Mr. {name} was seen on Monday.
Je m'appelle {name} et je viens de Lyon.
Madame {name} a signé la lettre hier.
Mein Name ist {name} und ich wohne hier.
Sehr geehrter Herr {name}, vielen Dank.
Me llamo {name} y vivo en Madrid.
La señora {name} llegó tarde.
Ask for Ms. {name} at the desk.
Name: {name}
Employee {name} started in May.
password={secret}
password: {secret}
the words password={secret} and more words follow
passwd = "{secret}"
here is api_key={secret} for the test
api_key = "{secret}"
some words token = "{secret}" then other words
token: {secret}
mot | mot | token = "{secret}" | mot.
export SECRET_KEY='{secret}'
secret = '{secret}';
client_secret: "{secret}",
Authorization: Bearer {secret}
use token {secret} for now
the key {bare} was found in the log
{bare} then some other words came
and {bare} in between of words
clave = "{secret}" y otras palabras
Das Passwort: {secret} bitte nicht weitergeben.
his IBAN {iban} is on the invoice
IBAN: {iban} please pay soon
pay to account {iban} today
account number {account} was closed
send it to account {account} at once
Account: {account}
my account {account}, please
the account {account}
account no. {account}
Konto {account} ist leer.
ssn {ssn} was written there
SSN: {ssn} as given
The name of the game is to win at home.
Thank you for the letter. Anna came by train.
Contact the office before noon. It opens at nine.
Thousands of them were sent. Whitehall stayed closed.
London Paris Rome Berlin. Spring Summer. Monday Monday!
He said No. Never Never. Then Yes, Yes indeed.
Great Britain and New Zealand met in South Africa.
Der Mann ging nach Hause. Die Frau Las das Buch.
Der Alte Fritz. Am Morgen Kam Der Wind. Das Haus ist Rot.
Les Champs Élysées. La Ville est Belle. Le Soir Tombe.
El Niño Llegó. La Casa Blanca es Grande. Los Perros.
It is Red. They Came Home. This is The End. By Noon, By Night.
Dear friends, welcome. We met Mr. and Mrs. in the hall.
THE END OF THE STORY. EINE NEUE WELT. LE ROI EST MORT!!
Written by hand in ink. Signed and sealed in 1812.
Zu und. Es war kalt. Raes. La la la. No no.
In 1998 there were 25 people and 3 dogs in room 12.
Call 555 2485 or write to the office, room 7.
The password is changed every month by the staff.
A token = sign stands between the name and the value.
This work is licensed under the GNU General Public License, version 3.
All rights reserved. Copyright 2020 by the authors.
The token ring was an early network. Key figures rose by 4%.
His account of the war was long. An account of 1914 follows.
See http://example.com/a/b?c=d for more on that.
https://example.org/{hash}/page?id=20394857
Version 2.0.1 was out on 2021-03-04 at 10:45.
Order 20394857 was shipped on the 4th. Item A1234 is back.
The hash {hash} of the file.
commit {hash} fixes the build
sha256: {hash}
md5 sum {hash} matches
Write to some.one@mail.example.com or other@example.org today.
From 192.168.10.4 to 10.0.0.255 in 3 ms.
Pay with 4929123412341234 or 4929 1234 1234 1234 here.
Phone +49 30 1234567 or +1 (555) 123-4567 after six.
x = 12; y = "some text"; color = "#ff00aa";
class="content" id="main" width=300
count=17 name="first" type='text' value="hello"
the internationalisation of incomprehensibilities and counterrevolutionaries
"Quoted words here," she said; 'and others' too.
LOUD!!! and### Strange*** signs%%% Stand&&& behind$$$ Words@@@ here~~~
so%%% it&&& Goes*** On### and!!! Yet$$$ it,&&& never.*** Ends%%%
Write to {email} or {email} today.
{email}, {email}
contact {email} for more, or call the desk.
For For the the And And is is All All By By of of Was Was The The
No name here. The key. A Contact. The Patient. Is Is. Employee of the month.
Names of towns: {town}, {town} and {town}.
{town} is a town. {town} {town} lies by the sea.
{town}
{town} {town}.
"{town} {town}!" {town}; {town} {town}
the {town} of {town}, in {town} by the {town}
"""
FIRST = "Anna John Maria Peter Olga Thomas Lucia Emily Hugo Claire Jonas Carmen Daniel Nina Pierre Hans Élodie José Greta Paul Ingrid Diego Sarah Luis".split()
LAST = "Keller Miller Lopez Hansen Petrov Weber Romano Carter Blanc Dubois Schmidt Ruiz Okafor Berg O'Neill García Müller Lefèvre Novak Fischer Smith-Jones Moreau Vega Lindqvist".split()
HEX, UPPER, MIXED = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FILLS = 6  # of each line with a slot


def _fill(kind: str, rng: random.Random) -> str:
    def run(signs, least, most):
        return "".join(rng.choices(signs, k=rng.randint(least, most)))

    if kind == "name":
        return " ".join([rng.choice(FIRST), rng.choice(LAST)][rng.random() < 0.15 :])
    if kind == "iban":
        return run(UPPER[:26], 2, 2) + run("0123456789", 2, 2) + run("0123456789" if rng.random() < 0.6 else UPPER, 11, 22)
    if kind == "ssn":
        return "-".join(run("0123456789", k, k) for k in (3, 2, 4))
    if kind == "account":
        return run("0123456789", 7, 12)
    if kind == "email":
        return run(HEX[10:] + "mnorst", 2, 9) + rng.choice([".", "_", ""]) + run("0123456789", 0, 3) + "@" + rng.choice(["mail", "web", "post"]) + run("0123456789", 0, 1) + rng.choice([".example.com", ".org", ".co.uk"])
    if kind == "town":
        return (run("BDFGKLMNPRSTV", 1, 1) + "".join(rng.choice("aeiouéö") + rng.choice("bdglmnrst") for _ in range(rng.randint(1, 4)))) + rng.choice(["", "e", "o", "berg"])
    if kind == "hash":
        return run(HEX, 32, 64)
    keys = ["AKIA" + run(UPPER, 16, 16), "ghp_" + run(MIXED, 30, 36), "sk-" + run(MIXED, 24, 48), "xoxb-" + run("0123456789", 10, 12) + "-" + run(MIXED, 20, 24)]
    if kind == "bare":
        return rng.choice(keys)
    return rng.choice([run(HEX, 16, 64), run(HEX, 32, 40), run(MIXED, 12, 64), run(MIXED + "+/", 30, 60) + "=", run(MIXED + "!$%_", 9, 16) + run("0123456789", 1, 3), rng.choice(keys)])


KIND_OF = {"name": "name", "secret": "secret", "bare": "secret", "iban": "account", "ssn": "account", "account": "account", "hash": None, "email": None, "town": None}


def filled(lines: list[str], rng: random.Random, fills: int = FILLS) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans of the added kinds) of each line; one with slots comes ``fills`` times."""
    out = []
    for line in lines:
        parts = re.split(r"\{(\w+)\}", line)
        for _ in range(fills if len(parts) > 1 else 1):
            text, spans = "", []
            for i, part in enumerate(parts):
                piece = _fill(part, rng) if i % 2 else part
                if i % 2 and KIND_OF[part]:
                    spans.append((len(text), len(text) + len(piece), KIND_OF[part]))
                text += piece
            out.append((text, spans))
    return out


def shape(word: str) -> str:
    """Runs of capitals, small letters, digits and other signs as X, x, 0 and the sign."""
    s = re.sub("[0-9]+", "0", re.sub(r"[^\W\d_A-Z]+", "x", re.sub("[A-Z]+", "X", word)))
    return s if len(s) <= 8 else f"{s[:4]}~{min(len(s), 40) // 4}"


CUES = set("name appelle m'appelle llamo contact dear mr mrs ms dr herr frau madame monsieur señora señor geehrter regards sincerely ask patient employee iban ssn account konto number password passwd passwort clave token key secret bearer authorization hash commit sha256 md5 sum is ist = : |".split())
SIZES = [2, 4, 7, 10, 13, 16, 20, 28, 36, 48, 72]
EDGE = ".,;:!?()[]{}<>|\"'`"
SIGNS = EDGE + "#$%&*@~^"  # left out of a word's features
N_FEATURES = 9


def word_features(word: str) -> list[str]:
    bare = word.strip(SIGNS)
    key, sign, value = bare.rpartition("=") if "=" in bare[:-1] else ("", "", bare)
    if sign:
        bare = value.strip(SIGNS) or bare
    low = bare.lower()
    digits = sum(c.isdigit() for c in bare)
    turns = len(re.findall(r"[0-9][^\W\d_]|[^\W\d_][0-9]", bare))
    kind = ("mix" if any(c.isalpha() for c in bare) else "num") if digits else "alpha" if bare else "sign"
    signs = "hex" if re.fullmatch("[0-9a-f]+", bare) else "up" if re.fullmatch("[0-9A-Z]+", bare) else "word" if re.fullmatch("[0-9A-Za-z]+", bare) else "b64" if re.fullmatch("[0-9A-Za-z+/_=-]+", bare) else "other"
    size = bisect.bisect_left(SIZES, len(bare))
    cue = low if low in CUES else word if word in CUES else "-"
    key = re.split(r"[^a-z]+", key.lower())[-1] if key else ""
    return [
        f"s={shape(bare)}", f"n={size}|k={kind}", f"k={kind}|t={min(turns, 12) // 2}", f"c={cue}|{word[-1:] if word[-1:] in ':=,.' and cue != '-' else ''}", f"e={word[-1:] if word[-1:] in EDGE else '-' if word[-1:].isalnum() else '#'}",
        f"a={(key if key in CUES else '+') if sign else '-'}", f"q={word[:1] if word[:1] in EDGE else '-'}", f"g={signs}|n={size}|d={min(digits, 12) // 3}", f"p={bare[:4] if len(bare) > 12 and not bare.isalpha() and not bare[:4].isdigit() else '-'}",
    ]


PLACES = ("0", "<", ">", "<<")  # the word itself, as the one before, the one after, the one before that


def _ids(word: str) -> list[list[int]]:
    """Feature ids of a word in each of its places."""
    names = word_features(word)
    return [[feature(f"{where}{x}") for x in names] for where in PLACES]


NONE = [[feature(f"{where}edge{i}") for i in range(N_FEATURES)] for where in PLACES]


def labelled(seed: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features and labels of each line of the labelled table."""
    items, labels = [], []
    for text, spans in filled(LABELLED.splitlines(), random.Random(seed)):
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
        tags = []
        for m in found:
            own = next(((s, k) for s, e, k in spans if m.start() < e and m.end() > s), None)
            tags.append(0 if own is None else LABELS.index(("B-" if m.start() <= own[0] else "I-") + own[1]))
        ids = [NONE, NONE, *(_ids(m[0]) for m in found), NONE]
        items.append(np.array([ids[i][0] + ids[i - 1][1] + ids[i + 1][2] + ids[i - 2][3] for i in range(2, len(ids) - 1)]))
        labels.append(np.array(tags))
    return items, labels


def train() -> Crf:
    return Crf(len(LABELS)).fit(*labelled(), decay=2e-4)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index of kind, start, end) of the fixed patterns, by kind, then start; linear in the text."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    for m in NUMBERS.finditer(text):
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            stop = start + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                out.append((1, start, stop))
            start = stop + 1
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


class Tagger:
    """Scores of distinct words, kept by a worker; starts afresh beyond ``most`` words (no influence on results)."""

    def __init__(self, crf: Crf, most: int = 400_000):
        self.crf, self.most = crf, most
        self.rows: dict[int, int] = {}
        self.kinds: dict = {}
        self.parts = np.zeros((1 << 12, len(PLACES), len(LABELS)), np.float32)
        self.bound = np.zeros((1 << 12, len(PLACES)))
        move = crf.move - crf.move[0, 0]
        self.slack = max(0.0, move[:, 1:].max(), (crf.first - crf.first[0])[1:].max()) + max(0.0, move[1:, 0].max())
        self.edge = [crf.weights[x].sum(0) for x in NONE]

    def __reduce__(self):
        return Tagger, (self.crf, self.most)

    def _row(self, word: str) -> int:
        """Row of a word's features; words with the same features share it."""
        core = word.rstrip(".,;:!?")
        if core.isalpha() and len(word) - len(core) < 2 and (core.islower() or ("A" <= core[0] <= "Z" and core[1:].islower())) and core.lower() not in CUES and not re.fullmatch("[a-f]+", core):
            key = bisect.bisect_left(SIZES, len(core)), word[len(core) :], core.islower(), core.isascii()  # all that the features of such words tell
        else:
            key = tuple(word_features(word))
        row = self.kinds.get(key)
        if row is None:
            row = self.kinds[key] = len(self.kinds)
            if row >= len(self.parts):
                self.parts = np.concatenate((self.parts, np.zeros_like(self.parts)))
                self.bound = np.concatenate((self.bound, np.zeros_like(self.bound)))
            self.parts[row] = part = self.crf.weights[_ids(word)].sum(1)
            self.bound[row] = part[:, 1:].max(1) - part[:, 0]
        return row

    def _rows(self, words: Words) -> np.ndarray:
        """Row of every word of a slice in ``parts`` and ``bound``."""
        code, distinct = pd.factorize(words.hashes())
        if len(self.rows) > self.most:
            self.rows.clear()
            self.kinds.clear()
        where = np.full(len(distinct), -1)
        firsts = np.zeros(len(distinct), np.int64)
        firsts[code[::-1]] = np.arange(len(code))[::-1]
        raw = words.raw.tobytes()
        for i, h in enumerate(distinct.tolist()):
            row = self.rows.get(h)
            if row is None:
                row = self.rows[h] = self._row(raw[words.start[firsts[i]] : words.end[firsts[i]]].decode("utf-8", "replace"))
            where[i] = row
        return where[code]

    def spans(self, words: Words) -> list[tuple[int, int, int, int]]:
        """(text, index of added kind, first word, last word) in a slice.

        Lines where no word can gain by any label but O keep O throughout; that
        follows from bounds on the scores, so only the others are decoded.
        """
        n = len(words.start)
        if not n:
            return []
        row = self._rows(words)
        line = np.zeros(len(words.raw) + 1, np.int64)
        line[1:] = np.cumsum(words.raw == 10)
        new = np.concatenate(([True], (words.doc[1:] != words.doc[:-1]) | (line[words.start[1:]] != line[words.start[:-1]])))
        last = np.append(new[1:], True)
        second = new | np.roll(new, 1)
        limit = [e[1:].max() - e[0] for e in self.edge]
        gain = self.bound[row, 0] + self.slack
        gain += np.where(new, limit[1], self.bound[np.roll(row, 1), 1])
        gain += np.where(last, limit[2], self.bound[np.roll(row, -1), 2])
        gain += np.where(second, limit[3], self.bound[np.roll(row, 2), 3])
        number = np.cumsum(new) - 1
        open_ = np.zeros(number[-1] + 1, bool)
        open_[number[gain >= 0]] = True
        at = np.flatnonzero(open_[number])
        if not len(at):
            return []
        new, last, second = new[at], last[at], second[at]
        emit = self.parts[row[at], 0].astype(np.float64)
        emit += np.where(new[:, None], self.edge[1], self.parts[row[at - 1], 1])
        emit += np.where(last[:, None], self.edge[2], self.parts[row[np.minimum(at + 1, n - 1)], 2])
        emit += np.where(second[:, None], self.edge[3], self.parts[row[at - 2], 3])
        tag = self.crf.decode(emit, np.append(np.flatnonzero(new), len(at)))
        out = []
        for i in np.flatnonzero(tag):
            kind, inside, w = (tag[i] - 1) // 2, (tag[i] - 1) % 2, int(at[i])
            if inside and out and out[-1][3] == w - 1 and out[-1][1] == kind and not new[i]:
                out[-1] = (*out[-1][:3], w)
            else:
                out.append((int(words.doc[w]), int(kind), w, w))
        return out


QUOTED = re.compile(rf"[{re.escape(EDGE)}]*?([\"'`])([^\"'`]+)\1")
SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"


def find_pii(docs: DataFrame, *, text: str = "text", crf: Crf | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``pii``: spans in code points, ends exclusive, by kind (base kinds first), then start.

    Base spans are always there; spans that the field adds have ``base = false``
    and leave out marks at their ends.  Null and empty texts have none.  Other
    columns pass through, or those named in ``keep``; one named ``pii`` is replaced.
    """
    given, place, source = beside(docs, text, ["pii"], keep)
    shared = docs.sparkSession.sparkContext.broadcast(Tagger(crf or train()))
    kinds = KINDS + ADDED

    @freed
    def run(batches):
        for part in text_slices(batches, place):
            col = part.column(place)
            words = Words(col, lower=False)
            hint = np.isin(words.raw, np.frombuffer(b"@0123456789", np.uint8))
            some = np.concatenate(([0], np.cumsum(hint)))[words.off]
            found: list[list] = [[] for _ in range(len(col))]
            for i in np.flatnonzero(np.diff(some)):
                found[i] = [(k, s, e, True) for k, s, e in base_spans(col[int(i)].as_py())]
            chars = np.concatenate(([0], np.cumsum((words.raw & 0xC0) != 0x80)))
            for d, k, a, b in shared.value.spans(words):
                lo, hi = int(words.start[a]), int(words.end[b])
                piece = words.raw[lo:hi].tobytes().decode("utf-8", "replace")
                cut = piece.rstrip(EDGE)[:-1].rfind("=") + 1 if ADDED[k] == "secret" else 0  # of key=value the value
                s = int(chars[lo] - chars[words.off[d]]) + len(piece) - len(piece[cut:].lstrip(EDGE))
                e = s + len(piece[cut:].strip(EDGE))
                if ADDED[k] == "secret" and (m := QUOTED.match(piece, cut)):
                    e = s + len(m[2])
                if e > s:
                    found[d].append((len(KINDS) + k, s, e, False))
            spans = [[{"kind": kinds[k], "start": s, "end": e, "base": b} for k, s, e, b in sorted(x)] for x in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(given)], pa.array(spans, kind)], [*(f.name for f in given), "pii"])

    return source.mapInArrow(run, schema_with(given, f"pii {SPANS}"))


def op5_pii(spark, sf_dir) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("pii", lambda s: s.base)

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def of_kind(kind):
        return F.size(F.filter("pii", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")

    counts = [of_kind(k) for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))
