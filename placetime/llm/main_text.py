"""Main text of pages: a linear-chain conditional random field over leaf blocks.

A page becomes its leaf blocks (`page_blocks`).  The field tags each as text or as other (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments) from features of its ancestors (tags, words of class, id and
role) and of its text (length, share of links, end, signs); Viterbi finds the best tags of the whole page.

Labelled pages: TRAIN_PAGES pages of the corpus, those with the smallest hash of their content.  Pages that say where
their article is are labelled by that.  As one corpus has few layouts, every one of them also lends its sentences
to LAYOUTS composed pages whose blocks are known, in layouts of all the kinds above, with and without telling tags and names.  That bound on labelled rows is the only sample; all pages are extracted whole.

Null and blank pages have no text, as have pages without any block tagged as text.  Repeated rows are extracted alike.
Broken markup is read as browsers do.  Other columns are kept out of the result.
"""

from __future__ import annotations

import html
import random
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import chain_crf
from .common import python_ready
from .page_blocks import Block, Element, blocks_of

TRAIN_PAGES, LAYOUTS, EPOCHS = 150, 4, 120
OTHER, TEXT = 0, 1
#: Bounds of the length classes, in words.
LENGTHS = (1, 2, 4, 8, 15, 30, 60)


#: Names of elements by kind, for features and for composed pages.
NAMES = {
    "text": "article content post entry story main body text article-body post-content entry-content story-text main-content page-content prose",
    "header": "header masthead topbar branding site-header logo site-title",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs main-menu toc pagination pager",
    "footer": "footer foot colophon site-footer copyright legal credits bottom",
    "sidebar": "sidebar side rail widget widgets related popular trending recommended recent-posts more-stories",
    "notice": "notice cookie cookies cookie-notice cookie-banner consent gdpr alert banner popup modal overlay disclaimer paywall announcement",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion ad-slot banner-ad",
    "form": "form search search-form newsletter subscribe signup login contact-form feedback",
    "comments": "comments comment-list reader-comments discussion responses replies comment-section user-comments",
    "share": "share social sharing share-buttons follow social-links",
}
TAGS = {"header": "header", "menu": "nav", "footer": "footer", "sidebar": "aside", "advert": "aside", "form": "form", "notice": "aside", "comments": "section"}
TAG_KINDS = {"header": "header", "nav": "menu", "footer": "footer", "aside": "sidebar", "form": "form", "article": "text", "main": "text"}
#: Words of names that tell a kind; those that stand in names of several kinds tell the first.
KINDS = {w: kind for kind, names in reversed(NAMES.items()) for name in names.split() for w in name.split("-") if w not in ("site", "more", "user", "bottom")}


@lru_cache(100_000)
def path_features(path: tuple[Element, ...]) -> tuple[str, ...]:
    out = {f"in:{e.tag}" for e in path} | {f"name:{n}" for e in path for n in e.names}
    if path:
        out |= {f"at:{path[-1].tag}"} | {f"own:{n}" for n in path[-1].names}
        kinds = [k for k in map(kind_of, path) if k]
        out |= {f"kind:{k}" for k in kinds} | {"inner:" + (kinds[-1] if kinds else "none"), "outer:" + (kinds[0] if kinds else "none")}
    return tuple(sorted(out))


@lru_cache(100_000)
def kind_of(element: Element) -> str | None:
    """What the names of an element, or else its tag, tell; kinds other than text come first."""
    told = {KINDS[n] for n in element.names if n in KINDS}
    return min(told - {"text"}, default=None) or TAG_KINDS.get(element.tag) or min(told, default=None)


def text_features(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    share = block.links / len(text)
    return [
        f"words:{sum(words > x for x in LENGTHS)}",
        "links:" + ("none" if not block.links else "some" if share < 0.5 else "most"),
        "end:" + ("stop" if text[-1] in ".!?…。\"”" else "open"),
        *(["copyright"] if "©" in text else []), *(["bars"] if "|" in text or "·" in text else []),
    ]


def features_of(blocks: Sequence[Block]) -> list[tuple[tuple[str, ...], list[str]]]:
    """Of each block: features of its path, and of its text and page."""
    paths = [path_features(b.path) for b in blocks]
    marked = [any(e.tag in ("article", "main") for e in b.path) for b in blocks]
    whole = "page:marked" if any(marked) else "page:plain"
    return [(p, [*text_features(b), whole if not m else "page:inside"]) for p, b, m in zip(paths, blocks, marked)]


# -- labelled pages -----------------------------------------------------------------------------------------------
MARK = ""      # begins every block of main text in a composed page
LAYOUT_NAMES = "row col container wrapper inner clearfix box grid left right".split()


class Composer:
    """Composes pages from a page's own sentences."""

    def __init__(self, rnd: random.Random, sentences: list[str]):
        self.rnd, self.sentences = rnd, sentences

    def some(self, low: int, high: int) -> str:
        words = " ".join(self.rnd.choice(self.sentences) for _ in range(3)).split()
        n = self.rnd.randint(low, high)
        while len(words) < n:
            words += self.rnd.choice(self.sentences).split() or ["word"]
        return html.escape(" ".join(words[:n]), quote=False)

    def sentence(self) -> str:
        return self.some(3, 40) + self.rnd.choice([".", ".", ".", "", "!"])

    def box(self, kind: str, inner: str) -> str:
        """An element of the kind, by tag, by name or by both."""
        rnd = self.rnd
        name = rnd.choice(NAMES[kind].split())
        tag, named = rnd.choice([(TAGS.get(kind, "div"), False), ("div", True), ("section", True), (TAGS.get(kind, "div"), True)])
        if kind not in TAGS or kind in ("comments", "notice", "advert"):
            named = True
        extra = rnd.choice(["", "", " " + rnd.choice(LAYOUT_NAMES)])
        attribute = f' {rnd.choice(["class", "class", "id"])}="{name}{extra}"' if named else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self) -> str:
        items = [f'<a href="/{k}">{self.some(1, 4)}</a>' for k in range(self.rnd.randint(2, 8))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.rnd.random() < 0.7 else "<p>" + " | ".join(items) + "</p>"

    def other(self, kind: str) -> str:
        rnd = self.rnd
        if kind == "header":
            inner = rnd.choice(["<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>", "<h1>{}</h1><p>{}</p>", "<a href='/'>{}</a>"]).replace("{}", self.some(1, 6)) + rnd.choice(["", self.links()])
        elif kind in ("menu", "share"):
            inner = self.links()
        elif kind == "footer":
            inner = rnd.choice(["<p>&copy; {}</p>", "&copy; {} &middot; {}", "<p>{}</p><p>{}</p>", "<div>{}</div>", "{}"]).replace("{}", self.some(2, 14)) + rnd.choice(["", "", self.links()])
        elif kind == "sidebar":
            inner = f"<h{rnd.randint(2, 4)}>{self.some(1, 4)}</h3>" * rnd.randint(0, 1) + rnd.choice([self.links(), f"<p>{self.sentence()}</p>", f"<p>{self.sentence()}</p>" * 2, self.sentence()])
        elif kind == "form":
            inner = f"<label>{self.some(1, 4)}</label><input name=q><p>{self.some(2, 12)}</p><button>{self.some(1, 2)}</button>"
        elif kind == "comments":
            shape = rnd.choice(["<div class=comment><p>{}</p></div>", "<li class='comment'><p class=author>{a}</p><p>{}</p></li>", "<article class=comment><p>{}</p></article>", "<article><p>{}</p></article>", "<p>{}</p>", "<div><b>{a}</b><p>{}</p><p>{}</p></div>"])
            inner = f"<h3>{self.some(1, 3)}</h3>" * rnd.randint(0, 1) + "".join(shape.replace("{a}", self.some(1, 2)).replace("{}", self.sentence()) for _ in range(rnd.randint(1, 5)))
        else:
            inner = rnd.choice(["<p>{}</p>", "{}", "<a href='/x'>{}</a>", "<p>{}</p><p>{}</p>", "<div>{}</div>"]).replace("{}", self.sentence())
        return self.box(kind, inner)

    def main(self) -> str:
        rnd = self.rnd
        para = lambda: rnd.choice(["<p>{}</p>"] * 8 + ["<h2>{s}</h2>", "<ul><li>{}</li><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<div>{}</div>", "<pre>{}</pre>",
                                  "<table><tr><td>{s}</td><td>{s}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>", "<p><b>{}<br><p>{}</p>", "<p>{s} <a href=/y>link</a> {s}</p>", "<p><a href=/y>" + MARK + "link</a></p>"])
        out = []
        for _ in range(rnd.randint(1, 12)):
            shape = para()
            while "{}" in shape:
                shape = shape.replace("{}", MARK + self.sentence(), 1)
            while "{s}" in shape:
                shape = shape.replace("{s}", MARK + self.some(1, 6), 1)
            out.append(shape)
        title = f"<h1>{MARK}{self.some(1, 12)}</h1>"
        head = rnd.choice([title, title, "", f"<header>{title}</header>", f'<header class="entry-header">{title}</header>'])
        for kind in ("advert", "share", "notice", "sidebar", "form", "menu"):
            if rnd.random() < 0.12:
                out.insert(rnd.randint(0, len(out)), self.other(kind))
        late = self.other("comments") if rnd.random() < 0.25 else ""
        inner = head + "".join(out) + late
        name = rnd.choice(NAMES["text"].split())
        return rnd.choice([
            f"<article>{inner}</article>", f"<article>{inner}</article>", f"<article class='{name}'>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
            f"<main>{head}<article>{''.join(out)}</article>{late}</main>", f"<div class='{name}'>{inner}</div>", f"<div id={name}>{inner}</div>", f"<section class='{name}'>{inner}</section>", inner, f"<div>{inner}</div>",
        ])

    def page(self) -> str:
        rnd = self.rnd
        maybe = lambda kind, p: self.other(kind) if rnd.random() < p else ""
        before = [maybe("notice", 0.25), maybe("header", 0.5), maybe("menu", 0.6), maybe("advert", 0.4), maybe("form", 0.15), maybe("sidebar", 0.2)]
        after = [maybe("share", 0.15), maybe("advert", 0.2), maybe("comments", 0.4), maybe("sidebar", 0.4), maybe("form", 0.2), maybe("notice", 0.15), maybe("footer", 0.7)]
        inner = "".join(before) * (rnd.random() < 0.7) + self.main() + "".join(after) * (rnd.random() < 0.85)
        if rnd.random() < 0.2:
            inner = f'<div class="{rnd.choice(LAYOUT_NAMES)}">{inner}</div>'
        return f"<html><head><title>{self.some(2, 8)}</title></head><body>{inner}</body></html>"


def by_markup(blocks: Sequence[Block]) -> list[int] | None:
    """Tags of a page that says where its article is; None if it does not."""
    out = set("nav aside footer form".split())
    tags = [TEXT if "article" in (own := {e.tag for e in b.path}) and not own & out else OTHER for b in blocks]
    return tags if TEXT in tags else None


def labelled_pages(pages: Sequence[str]) -> list[tuple[list[list[str]], list[int]]]:
    """Feature and tag sequences: the pages' own, where they say it, and composed ones."""
    found = []
    add = lambda blocks, tags: found.append(([[*p, *t] for p, t in features_of(blocks)], tags))
    for page in pages:
        blocks = blocks_of(page)
        if not blocks:
            continue
        if tags := by_markup(blocks):
            add(blocks, tags)
        rnd = random.Random(zlib.crc32(page.encode("utf-8", "surrogatepass")))
        composer = Composer(rnd, [b.text[:2000] for b in blocks])
        for _ in range(LAYOUTS):
            made = blocks_of(composer.page())
            tags = [TEXT if MARK in b.text else OTHER for b in made]
            add([b._replace(text=b.text.replace(MARK, "") or "x") for b in made], tags)
    return found


def trained(pages: DataFrame, most: int = TRAIN_PAGES, epochs: int = EPOCHS) -> chain_crf.Field | None:
    """The field, from the `most` pages with the smallest hash of their content; None without any block."""
    own = pages.select(F.col("html").cast("string").alias("html")).where("html is not null").select(F.xxhash64("html").alias("key"), "html")
    rows = own.orderBy("key", "html").limit(most).collect()
    sequences = labelled_pages([r.html for r in rows])
    return chain_crf.fit(sequences, 2, epochs) if sequences else None


def extract(page: str | None, field: chain_crf.Field | None, known: dict) -> str:
    """The main text of a page; `known` keeps scores of paths between pages."""
    blocks = blocks_of(page)
    if not blocks or field is None:
        return ""
    scores = []
    for path, own in features_of(blocks):
        if path not in known:
            known[path] = field.scores(path)
        scores.append([a + b for a, b in zip(known[path], field.scores(own))])
    return "\n".join(b.text for b, tag in zip(blocks, field.tags(scores)) if tag == TEXT)


def main_texts(pages: DataFrame, field: chain_crf.Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    python_ready(pages.sparkSession)
    field = trained(pages) if field is None else field

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = []
            for page in batch.column(2).to_pylist():
                if len(known) > 100_000:
                    known.clear()
                texts.append(extract(page, field, known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
