"""Main text of web pages: a conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks in page order, each with its ancestors' tags,
class and id words, and its text.  A linear-chain field, trained on the labelled
pages below, marks each block as main text or not; Viterbi decodes all pages of
an Arrow batch together.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, freed, schema_with, table, text_slices
from .crf import Crf, feature

# Fixed sets of element names.
UNSEEN = "script|style"  # their text is never shown; unclosed ones end with the page
FIELDS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.IGNORECASE) for x in ("template", "textarea", "select", "iframe", "svg")}  # nor is that of these, if they are closed
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Opening one of these ends an open element of the same set, up to the nearest other block.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
HOLDS_LI = {"ul", "ol", "menu", "table", "tbody", "thead", "tfoot", "dl", "select"}

_REST = r"(?>=\s*(?>\"[^\"]*\"|'[^']*')|[^>])*+"  # of a tag after its name: a > inside a quoted value doesn't end it
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({UNSEEN})(?=[\s/>]){_REST}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>{_REST})>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<more2>[^>]*)>|<[!?][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = {"class", "id", "role", "hidden", "aria-label", "itemprop"}
DEPTH = 512  # elements nested deeper are counted by name, and tell the field nothing more
SPACES = re.compile(r"\s+")


@lru_cache(1 << 13)
def _hints(attributes: str) -> tuple[str, ...]:
    """Words of the attributes that tell what an element is for."""
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in TELLING:
            value = (m[2] or m[3] or m[4] or m[1]).lower()
            out += [x for x in re.split(r"[^a-z]+", value) if x]
    return tuple(out)


def _hints_of(attributes: str) -> tuple[str, ...]:
    """``_hints``, without keeping long attributes."""
    return (_hints if len(attributes) < 300 else _hints.__wrapped__)(attributes)


def leaf_blocks(page: str) -> list[tuple[tuple[str, ...], tuple[str, ...], str, float]]:
    """(tags of ancestors, their class words, text, share of text in links) of each block with text, in page order."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out, text, linked = [], [], 0
    at = links = 0
    deep: Counter[str] = Counter()  # open elements beyond ``DEPTH``, all inside the last of the stack

    def end_block():
        nonlocal text, linked
        if text:
            whole = SPACES.sub(" ", entities.unescape("".join(text))).strip()
            if whole:
                tags = tuple(t for t, _ in stack)
                out.append((tags, tuple(x for _, hint in stack for x in hint), whole, min(1.0, linked / len(whole))))
            text, linked = [], 0

    def add(piece: str):
        nonlocal linked
        if piece:
            text.append(piece)
            linked += len(piece) if links else 0

    open_ended = set()  # fields that no later tag closes
    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, more = name.lower(), m["more"] or m["more2"] or ""
        if name == "br":
            text.append(" ")
            continue
        is_block = name in BLOCK
        if is_block:
            end_block()
        if m["end"] or m["end2"]:
            if deep:
                if deep[name]:
                    deep[name] -= 1
                elif is_block:  # it closes all that is deeper
                    deep.clear()
                deep += Counter()  # without names at zero
                if deep or not is_block:
                    links = sum(t == "a" for t, _ in stack) + deep["a"]
                    continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if not is_block and stack[i][0] in BLOCK:
                    break
            links = sum(t == "a" for t, _ in stack)
            continue
        if name in VOID or more.endswith("/"):
            continue
        if name in FIELDS and name not in open_ended:
            if close := FIELDS[name].search(page, at):
                at = close.end()
                continue
            open_ended.add(name)
        if is_block and deep:
            if end := next((x for x in CLOSES.get(name, ("p",)) if deep[x]), None):
                deep[end] -= 1
                deep += Counter()
        elif is_block:
            ends = CLOSES.get(name, ()) if name in CLOSES else {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in HOLDS_LI or (stack[i][0] in BLOCK and stack[i][0] != "p"):
                    if name == "tr" and stack[i][0] in ("td", "th"):
                        continue
                    break
            links = sum(t == "a" for t, _ in stack)
        elif name == "a":
            links += 1
        if len(stack) < DEPTH:
            stack.append((name, _hints_of(more) if more else ()))
        else:
            deep[name] += 1
    add(page[at:])
    end_block()
    return out


N_FEATURES = 14
GROUPS = {
    "ad": "ad ads advert advertisement adverts banner promo promotion sponsor sponsored sponsors", "comment": "comment comments reply replies disqus discussion respond",
    "side": "sidebar aside related recommended widget widgets rail popular trending", "note": "cookie cookies notice consent gdpr alert popup modal newsletter subscribe signup disclaimer banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar skip", "edge": "header footer masthead copyright legal site topbar bottom",
    "share": "share sharing social follow login search form", "main": "content article post entry story main body text articlebody",
}
GROUP_OF = {w: g for g, ws in GROUPS.items() for w in ws.split()}
REGIONS = ("nav", "header", "footer", "aside", "form", "head", "dialog", "button", "menu")


def block_features(block) -> list[int]:
    tags, hints, text, linked = block
    inside = set(tags)
    groups = {GROUP_OF[h] for h in hints if h in GROUP_OF}
    region = next((t for t in reversed(tags) if t in REGIONS or t in ("article", "main")), "-")
    leaf = next((t for t in reversed(tags) if t in BLOCK), "-")
    words = len(text.split(" ", 41))
    size = 0 if words < 4 else 1 if words < 10 else 2 if words < 25 else 3 if words < 41 else 4
    first = text[:1]
    names = [
        f"region={region}", f"article={'article' in inside or 'main' in inside}", f"bad={bool(inside & set(REGIONS))}", f"leaf={leaf}", f"region={region}|leaf={leaf}",
        f"groups={'+'.join(sorted(groups - {'main'}))}", f"any={bool(groups - {'main'})}", f"mainword={'main' in groups}", f"size={size}", f"links={round(linked * 3)}",
        f"end={text[-1:] if text[-1:] in '.!?:' else '-'}", f"start={'copy' if first == '©' else 'up' if first.isupper() else 'other'}", f"any={bool(groups - {'main'})}|article={'article' in inside}", "bias",
    ]
    return [feature(x) for x in names]


_P = [
    "The river rose slowly through the night, and by morning the lower fields stood under water.", "She had walked this road a hundred times.",
    "Nobody at the station could say when the next train would leave, so the crowd waited in the cold for hours without a word of complaint from anyone in the long line.",
    "It was over.", "Prices rose by four per cent in spring; wages did not follow", "He asked for bread, salt and a map of the coast: nothing more.",
]
_LI = ["Home", "News", "Sport", "About us", "Contact"]


def labelled_pages() -> list[tuple[str, list[str]]]:
    """Pages written for training, with the texts of their main blocks."""
    p = "".join(f"<p>{x}</p>" for x in _P)
    menu = "<ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in _LI) + "</ul>"
    ad, note = "Buy two, get one free. Only today.", "We use cookies to improve this site. Accept them or leave."
    foot, side = "© 2021 The Daily Paper. All rights reserved.", "Read also: ten ways to cook an egg."
    remark = "I do not agree with the author at all. The bridge was built later."
    head = "<head><title>A night by the river</title></head>"
    title, top = "A night by the river", f"<h1>{'A night by the river'}</h1>"
    main = [title, *_P]
    listed = "<ul><li>First, boil the water.</li><li>Then add salt and wait.</li></ul>"
    steps = ["First, boil the water.", "Then add salt and wait."]
    form = '<form action="/s"><p>Join our list</p><label>Your e-mail address</label><button>Send</button></form>'
    talk = f'<section class="comments"><h2>Comments</h2><div class="comment"><p>{remark}</p></div><div class="comment"><p>Thanks for this.</p></div></section>'
    return [
        (f'<html>{head}<body><nav>{menu}</nav><div class="ad">{ad}</div><article>{top}{p}</article><footer>{foot}</footer></body></html>', main),
        (f'<html>{head}<body><nav>{menu}</nav><article>{top}<p>{_P[1]}</p></article><footer>{foot} {_P[1]}</footer>', [title, _P[1]]),
        (f'<html>{head}<body><header><p>The Daily Paper</p>{menu}</header><main>{top}{p}{listed}</main><aside><p>{side}</p></aside><footer><p>{foot}</p></footer></body></html>', main + steps),
        (f'<body><div class="cookie-notice"><p>{note}</p></div><nav>{menu}</nav><article><h1>{title}</h1><div class="share">Share this</div>{p}{talk}</article><footer>{foot}</footer></body>', main),
        (f'<body><div id="header">The Daily Paper</div><div class="menu">{menu}</div><div class="content">{top}{p}</div><div class="sidebar"><p>{side}</p></div><div id="footer">{foot}</div></body>', main),
        (f'<body><div class="navbar">{menu}</div><div id="main"><div class="post">{top}{p}</div><div id="comments"><p>{remark}</p><p>{_P[0]}</p></div></div><div class="footer">{foot}</div></body>', main),
        (f'<body><nav>{menu}</nav><article><header>{top}</header>{p}<div class="ad">{ad}</div><p>{_P[2]}</p>{form}</article><aside class="related">{menu}<p>{_P[0]}</p></aside><footer>{foot}</footer></body>', [*_P, _P[2]]),
        (f'<body><nav>{menu}</nav><article>{top}<blockquote><p>{_P[0]}</p></blockquote>{listed}<h2>Later</h2><p>{_P[3]}</p></article>{talk}<footer>{foot}</footer></body>', [title, _P[0], *steps, "Later", _P[3]]),
        (f'<body><p class="notice">{note}</p><nav>{menu}</nav><article><p>{_P[3]}</p></article><div class="ad"><p>{_P[4]}</p></div></body>', [_P[3]]),
        (f'<body><nav>{menu}</nav><div class="promo">{_P[0]}</div><article>{top}<table><tr><td>Bread</td><td>3</td></tr></table><p>{_P[5]}</p></article><footer><p>{_P[1]}</p></footer></body>', [title, "Bread", "3", _P[5]]),
        (f'<body><article>{top}{p}</article></body>', main),
        (f'<body><nav>{menu}</nav><footer>{foot}</footer></body>', []),
        (f'<body>{form}<aside><p>{_P[2]}</p></aside><article>{p}<aside class="related"><p>{side}</p></aside></article><div class="newsletter"><p>{note}</p></div></body>', list(_P)),
        (f'<body><nav>{menu}</nav><article>{top}<pre>{_P[4]}</pre><figure><figcaption>{_P[1]}</figcaption></figure></article><div class="comments"><p>{_P[0]}</p></div></body>', [title, _P[4], _P[1]]),
    ]


def train() -> Crf:
    items, labels = [], []
    for page, main in labelled_pages():
        left, y = list(main), []
        blocks = leaf_blocks(page)
        for b in blocks:
            good = bool(left) and b[2] == left[0] and not (set(b[0]) & set(REGIONS)) and not {GROUP_OF.get(h) for h in b[1]} & {"ad", "comment", "side", "note"}
            y.append(int(good))
            left = left[1:] if good else left
        if left:
            raise AssertionError(f"unmatched main text {left[0]!r}")
        items.append(np.array([block_features(b) for b in blocks]))
        labels.append(np.array(y))
    return Crf(2).fit(items, labels, epochs=150)


def extract(pages: DataFrame, *, html: str = "html", crf: Crf | None = None, keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text``: the main blocks of each whole page, joined by line breaks; empty if none.

    Character references are decoded once, white space inside a block becomes
    one space.  Broken markup is read leniently: unclosed elements end with
    their parent, an unclosed comment, script or style hides the rest of the page.
    Text of other elements, known or not, is judged with the block it stands in.
    Null and empty pages give empty text.  Other columns pass through, or
    those named in ``keep``; one named ``text`` is replaced.
    """
    given, place, source = beside(pages, html, ["text"], keep)
    shared = pages.sparkSession.sparkContext.broadcast(crf or train())

    @freed
    def run(batches):
        for part in text_slices(batches, place):
            blocks = [leaf_blocks(h or "") for h in part.column(place).to_pylist()]
            bounds = np.concatenate(([0], np.cumsum([len(b) for b in blocks])))
            ids = np.array([block_features(b) for page in blocks for b in page], dtype=np.int64).reshape(-1, N_FEATURES)
            tag = shared.value.decode(shared.value.weights[ids].sum(1), bounds)
            texts = ["\n".join(b[2] for b, y in zip(page, tag[bounds[i] : bounds[i + 1]], strict=True) if y) for i, page in enumerate(blocks)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(given)], pa.array(texts, pa.string())], [*(f.name for f in given), "text"])

    return source.mapInArrow(run, schema_with(given, "text string"))


def op10_html_extract(spark, sf_dir) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
