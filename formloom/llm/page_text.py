"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the document tree.

A page's leaf blocks (runs of text between block-level tags, in page order) are the chain. A block's features are the
tags and the class, id and role words of its ancestors, and simple facts of its text; the labels are article text, reader
replies and everything else. Weights are fitted on labelled pages (whose elements carry a data-part attribute) by maximum
likelihood with forward and backward sums, pages are labelled by Viterbi's best path.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table

REST, MAIN, REPLY = 0, 1, 2
PARTS = {"rest": REST, "main": MAIN, "reply": REPLY}
#: Labelled pages for fitting, their seed, rounds, and the penalty of squared weights.
PAGES, SEED, ROUNDS, PENALTY = 1000, 5, 300, 0.1

# HTML's block-level, void and never shown elements.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("applet audio canvas datalist head iframe math noembed noframes noscript object option script select style svg template textarea title video".split())
#: A start tag ends an open element of these, unless one of the second set is nearer.
_ENDS = {t: (("p",), ("button", "table")) for t in BLOCK - {"button", "label"}} | {
    "li": (("p", "li"), ("ul", "ol", "menu")), "dt": (("p", "dt", "dd"), ("dl",)), "dd": (("p", "dt", "dd"), ("dl",)),
    "td": (("p", "td", "th"), ("table",)), "th": (("p", "td", "th"), ("table",)), "tr": (("p", "td", "th", "tr"), ("table",)),
}
_OTHERS = frozenset("aside button dialog footer form header nav".split())
_NAMED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# What short blocks outside articles often say.
_SAYS = {
    "sale": ["sponsor", "advert", "promo", "buy now", "discount", "anzeige", "publicit", "publicidad"],
    "terms": ["©", "(c)", "copyright", "all rights", "privacy", "cookie", "terms of", "imprint", "impressum", "mentions l", "consent", "datenschutz"],
    "ask": ["subscribe", "sign up", "sign in", "log in", "login", "newsletter", "share", "follow us", "register", "e-mail", "read more", "skip to", "related", "abonn", "suscr"],
    "talk": ["comment", "reply", "replies", " says", "posted", " ago", "kommentar", "antworten", "comentario"],
}


# Class and id words by part, as sites commonly name them.
_NAMES = {
    "main": "content article post entry body story text main page-content article-body entry-content post-content story-body articleText blog-post news-detail prose single",
    "nav": "nav menu navbar navigation main-menu breadcrumb breadcrumbs pagination pager toolbar nav-links tabs toc",
    "head": "header site-header masthead top topbar page-header banner branding logo",
    "foot": "footer site-footer page-footer copyright legal colophon bottom credits",
    "side": "sidebar side aside widget related related-posts recommended trending popular most-read teaser rail archive tags secondary infobox links more",
    "ad": "ad ads advert advertisement ad-slot sponsor sponsored promo promotion banner-ad commercial adsense adbox",
    "note": "notice alert cookie cookie-banner consent gdpr popup modal overlay message disclaimer paywall announcement warning",
    "form": "form newsletter subscribe signup search search-form login contact-form poll",
    "share": "share social sharing social-links follow buttons tools print",
    "reply": "comments comment comment-list replies reply discussion responses disqus thread user-comments feedback reviews guestbook",
}
_ROLES = {"nav": "navigation", "head": "banner", "foot": "contentinfo", "side": "complementary", "note": "alert", "form": "search"}
_NAMES = {k: v.split() for k, v in _NAMES.items()}
#: The part a word names; a word of several parts names none.
_KINDS = {w: k for k, names in _NAMES.items() for name in names for w in re.findall("[a-z]+", name.lower().replace("s-", "-").rstrip("s"))}
_KINDS = {w: k for w, k in _KINDS.items() if not any(w in re.findall("[a-z]+", " ".join(v).lower()) for j, v in _NAMES.items() if j != k)}


class Leaf:
    __slots__ = ("text", "context", "tag", "linked", "part")

    def __init__(self, text, context, tag, linked, part):
        self.text, self.context, self.tag, self.linked, self.part = text, context, tag, linked, part


class LeafBlocks(HTMLParser):
    """Leaf blocks of a page. Unclosed, misplaced and unknown tags are taken as browsers do, roughly: blocks close what
    is open inside them, stray end tags count as nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.leaves: list[Leaf] = []
        self.stack: list[tuple[str, frozenset, int]] = []  # tag, features of it and its ancestors, label
        self.places: dict[str, list[int]] = {}  # of open elements, by tag
        self.words: list[str] = []
        self.linked = self.links = self.silent = 0

    def updatepos(self, i, j):
        return j  # lines aren't counted

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, report)

    def end_leaf(self):
        text = " ".join("".join(self.words).split())
        if text:
            tag, context, part = next(((t, c, p) for t, c, p in reversed(self.stack) if t in BLOCK), ("body", frozenset(), REST)) if self.stack else ("body", frozenset(), REST)
            self.leaves.append(Leaf(text, context, tag, self.linked / max(1, len(text)), part))
        self.words, self.linked = [], 0

    def pop_to(self, place: int):
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            self.links -= tag == "a"
            self.silent -= tag in SILENT

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            if self.last("head") >= 0:
                self.pop_to(self.last("head"))
            self.end_leaf()
            ends, walls = _ENDS.get(tag, ((), ()))
            wall = max((self.last(w) for w in walls), default=-1)
            open_ = [x for x in map(self.last, ends) if x > wall]
            if open_:
                self.pop_to(min(open_))
        elif tag == "br":
            self.words.append(" ")
        if tag in VOID:
            return
        _, context, part = self.stack[-1] if self.stack else ("", frozenset(), REST)
        own, near = [f"tag {tag}"] if tag in BLOCK else [], []
        for name, value in attrs:
            if not value:
                if name == "hidden":
                    own.append("hidden")
            elif name in ("class", "id", "role", "itemprop"):
                words = [w.lower().rstrip("s") for w in _NAMED.findall(value)]
                own += [f"name {w}" for w in words]
                near += [f"near {w}" for w in words] + [f"kind {_KINDS[w]}" for w in words if w in _KINDS]
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
                own.append("hidden")
            elif name == "data-part":
                part = PARTS.get(value, part)
        if near:  # the nearest named element counts once more
            context = frozenset(f for f in context if f[:5] not in ("near ", "kind ")).union(near)
        held = tag in ("article", "main")
        if held and not context & {"tag article", "tag main"}:
            own.append("bare")  # until something named, or of another purpose, is opened inside
        elif "bare" in context and (tag in _OTHERS or any(f[0] != "t" for f in own)):
            context = context - {"bare"}
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, context.union(own) if own else context, part))
        self.links += tag == "a"
        self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash at a tag's end means nothing in HTML

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_leaf()
        place = self.last(tag)
        if place >= 0 and (tag in BLOCK or tag in SILENT or all(t not in BLOCK for t, _, _ in self.stack[place + 1 :])):
            self.pop_to(place)

    def handle_data(self, data):
        if not self.silent:
            self.words.append(data)
            if self.links:
                self.linked += len(data.strip())


def leaves(html: str | None) -> list[Leaf]:
    parser = LeafBlocks()
    parser.feed(html or "")
    parser.close()
    parser.end_leaf()
    return parser.leaves


def _size(n: int) -> int:
    return 0 if n == 1 else 1 if n < 4 else 2 if n < 9 else 3 if n < 20 else 4 if n < 60 else 5


def features(page: list[Leaf]) -> list[set[str]]:
    """Feature names of each leaf block. Ideographs count as words of two, so sizes mean the same in every script."""
    sizes = [_size(max(leaf.text.count(" ") + 1, len(leaf.text) // 12)) for leaf in page]
    out = []
    for k, leaf in enumerate(page):
        context, text, own = leaf.context, leaf.text, {"any", f"leaf {leaf.tag}", f"size {sizes[k]}"}
        held = "tag article" in context or "tag main" in context
        own |= context
        own |= {f"{x} {'inside' if held else 'outside'} article" for x in ("tag header", "tag footer", "tag aside", "tag nav", "tag section", "tag form", "tag ul", "tag h1", "tag p", "tag div") if x in context}
        own.add("no container" if len(context) <= 3 else "container")
        own.add(f"links {int(min(leaf.linked, 1) * 3.999)}")
        own.add("ends" if text[-1] in ".!?。।؟…\"”»" else "open end")
        own.add(f"size {sizes[k]} links {leaf.linked > 0.5} ends {text[-1] in '.!?。।؟'}")
        if len(text) < 400:
            low = text.lower()
            own |= {f"says {k} {'inside' if held else 'outside'} article" for k, said in _SAYS.items() if any(x in low for x in said)}
        own.add(f"before {sizes[k - 1] if k else 'start'}")
        own.add(f"after {sizes[k + 1] if k + 1 < len(page) else 'end'}")
        out.append(own)
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Crf:
    """Weights of features by label (emit), of neighbouring labels (move), of the first and the last label."""

    def __init__(self, names: dict[str, int], emit, move, first, last):
        self.names, self.emit, self.move, self.first, self.last = names, emit, move, first, last
        self.known: dict[frozenset, np.ndarray] = {}  # scores of feature sets met before

    def scores(self, page: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(page), len(PARTS)))
        if len(self.known) > 20_000:
            self.known.clear()
        for k, own in enumerate(map(frozenset, page)):
            score = self.known.get(own)
            if score is None:
                score = self.known[own] = self.emit[sorted(i for i in map(self.names.get, own) if i is not None)].sum(axis=0)
            out[k] = score
        return out

    def best(self, scores: np.ndarray) -> list[int]:
        """The most probable labels (Viterbi); ties go to the smaller label."""
        if not len(scores):
            return []
        score, back = scores[0] + self.first, []
        for s in scores[1:]:
            step = score[:, None] + self.move
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + s
        at = int((score + self.last).argmax())
        out = [at]
        for b in reversed(back):
            at = int(b[at])
            out.append(at)
        return out[::-1]

    def text(self, html: str | None) -> str:
        page = leaves(html)
        return "\n".join(leaf.text for leaf, label in zip(page, self.best(self.scores(features(page)))) if label == MAIN)


def likelihood(emit, move, first, last, gold, mask):
    """Log likelihood of padded chains and its gradients by scores, moves, first and last labels.

    emit: (pages, length, labels) scores; gold: labels; mask: which places are blocks (a run from the first place)."""
    n, t, s = emit.shape
    ahead, behind = np.empty_like(emit), np.zeros_like(emit)
    ahead[:, 0] = emit[:, 0] + first
    for k in range(1, t):
        ahead[:, k] = np.where(mask[:, k, None], _log_sum(ahead[:, k - 1, :, None] + move, 1) + emit[:, k], ahead[:, k - 1])
    whole = _log_sum(ahead[:, -1] + last, 1)
    behind[:, -1] = last
    for k in range(t - 2, -1, -1):
        behind[:, k] = np.where(mask[:, k + 1, None], _log_sum(move + (emit[:, k + 1] + behind[:, k + 1])[:, None, :], 2), behind[:, k + 1])
    some = np.exp(ahead + behind - whole[:, None, None]) * mask[..., None]
    truth = np.eye(s)[gold] * mask[..., None]
    pair = mask[:, 1:]
    moved = np.exp(ahead[:, :-1, :, None] + move + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * pair[..., None, None]
    stepped = np.einsum("nti,ntj->ij", truth[:, :-1] * pair[..., None], truth[:, 1:])
    ends = mask.sum(axis=1) - 1
    row = np.arange(n)
    value = (emit * truth).sum() + (stepped * move).sum() + (truth[:, 0] @ first).sum() + (truth[row, ends] @ last).sum() - whole.sum()
    return value, truth - some, stepped - moved.sum(axis=(0, 1)), (truth - some)[:, 0].sum(axis=0), (truth - some)[row, ends].sum(axis=0)


def fit(pages: list[str], rounds: int = ROUNDS, penalty: float = PENALTY) -> Crf:
    """Fit on labelled pages: the nearest ancestor's data-part (main, reply, rest) is a block's label, none means rest.

    The pages are held in memory: give a bounded number. Features seen on fewer than three pages are left out."""
    chains = [c for c in map(leaves, pages) if c]
    named = [features(c) for c in chains]
    seen: dict[str, int] = {}
    for page in named:
        for f in sorted(set().union(*page)):
            seen[f] = seen.get(f, 0) + 1
    names = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    s, lengths = len(PARTS), np.array([len(c) for c in chains], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    labels = np.array([leaf.part for c in chains for leaf in c], np.int64)
    # chains of like length go together, so little is padded: (places of the blocks, which of them are blocks)
    groups = []
    for mine in np.array_split(np.argsort(lengths, kind="stable"), max(1, min(12, len(chains)))) if chains else []:
        place = np.arange(lengths[mine].max())[None, :]
        mask = place < lengths[mine][:, None]
        groups.append((np.where(mask, starts[mine][:, None] + place, 0), mask))
    known = [sorted(names[f] for f in own if f in names) for page in named for own in page]
    ids = np.array([i for own in known for i in own], np.int64)
    block = np.repeat(np.arange(starts[-1]), [len(own) for own in known])
    shapes = [(len(names), s), (s, s), (s,), (s,)]
    at = np.cumsum([0, *[int(np.prod(x)) for x in shapes]])
    split = lambda w: [w[a:b].reshape(x) for a, b, x in zip(at, at[1:], shapes)]
    w, m, v = np.zeros(at[-1]), np.zeros(at[-1]), np.zeros(at[-1])
    for step in range(1, rounds + 1 if groups else 1):
        emit, move, first, last = split(w)
        scores = np.stack([np.bincount(block, emit[ids, j], starts[-1]) for j in range(s)], axis=1)
        by_score, rest = np.zeros_like(scores), [np.zeros_like(x) for x in (move, first, last)]
        for place, mask in groups:
            _, mine, *others = likelihood(scores[place], move, first, last, labels[place], mask)
            by_score[place[mask]] = mine[mask]
            rest = [x + y for x, y in zip(rest, others)]
        by_emit = np.stack([np.bincount(ids, by_score[block, j], len(names)) for j in range(s)], axis=1)
        gradient = np.concatenate([x.ravel() for x in (by_emit, *rest)]) - penalty * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w = w + 0.2 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(names, *split(w))


# --- labelled pages

_SOUNDS = [
    "the of and in ing er ation ly st re on for that with en be", "der und sch ein ich en keit ung für über ge zu auf", "le de la et que é eau tion oi les ou pas", "el que ción ar os ía ña para es del no",
    "по ст ре на ов ия пр ко не то", "का में है और सं र ने की ता", "に は の を が 東京 日本 文 書 新", "ال في من على ة ات ون ما",
]
_SOUNDS = [x.split() for x in _SOUNDS]
#: Lines that also stand in articles.
_TELLING = ["All rights reserved", "Copyright 2020", "Share", "Comments", "Reply", "Sponsored", "Cookies", "Sign up", "Log in", "Terms of use", "Related", "Subscribe"]


class _Writer:
    """Writes one labelled page: regions of invented text under the mark-up that sites use for them."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.sounds, self.junk = rng.choice(_SOUNDS), rng.random() < 0.15

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = ["".join(r.choices(self.sounds, k=r.randint(1, 3))) for _ in range(r.randint(low, high))]
        if self.junk:
            out = [w + r.choice(["***", "$$$", "&amp;&amp;", "###", ""]) for w in out]
        return " ".join(out)

    def sentence(self, low: int = 3, high: int = 22) -> str:
        return self.words(low, high).capitalize() + self.rng.choice([".", ".", ".", "!", "?", ",", ""])

    def prose(self, low: int = 1, high: int = 7) -> str:
        r = self.rng
        text = [self.sentence() for _ in range(r.randint(low, high))]
        if r.random() < 0.25:
            text[0] = f"<{(tag := r.choice(['b', 'em', 'strong', 'i', 'span', 'code']))}>{text[0]}</{tag}>"
        if r.random() < 0.2:
            text.append(f'<a href="/{r.randint(1, 99)}">{self.words(1, 5)}</a>' + r.choice([".", ""]))
        return r.choice([" ", " ", "<br>"]).join(text)

    def link(self, high: int = 4) -> str:
        return f'<a href="/{self.rng.randint(1, 99)}">{self.words(1, high)}</a>'

    def element(self, kind: str, tags: list[str], body: str, part: str = "") -> str:
        """Under a telling tag, a telling name, or both."""
        r = self.rng
        tag, name = r.choice(tags), r.choice(_NAMES[kind])
        if r.random() < 0.3:
            name += r.choice(["-box", "-wrapper", " clearfix", "_1", " col-3", "-inner"])
        named = r.random() < (0.55 if tag not in ("div", "section", "td") else 1)
        attr = f' {r.choice(["class", "class", "id"])}="{name}"' if named else ""
        if kind in _ROLES and r.random() < 0.15:
            attr = f' role="{_ROLES[kind]}"' + (attr if r.random() < 0.5 else "")
        return f"<{tag}{attr}{f' data-part={part}' if part else ''}>{body}</{tag}>"

    def links(self, low=3, high=9) -> str:
        r = self.rng
        items = [self.link() for _ in range(r.randint(low, high))]
        return r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items), lambda: "".join(f"<p>{x}</p>" for x in items)])()

    def rest(self, kind: str) -> str:
        r = self.rng
        p = lambda x: r.choice([f"<p>{x}</p>", x, f"<div>{x}</div>", f"<span>{x}</span>"])
        if kind == "nav":
            return self.element("nav", ["nav", "nav", "div", "menu", "ul"] if r.random() < 0.8 else ["div"], self.links(), "rest")
        if kind == "head":
            body = r.choice([f"<h1>{self.words(1, 4)}</h1>", p(self.link()), f"<h2>{self.words(1, 5)}</h2>", ""]) + r.choice([p(self.sentence(2, 10)), self.links(2, 6), p(self.words(2, 5))])
            return self.element("head", ["header", "header", "div"], body, "rest")
        if kind == "foot":
            line = r.choice(["&copy; 2024 ", "Copyright ", "&copy; example.org &middot; ", "", "", "All rights reserved. "]) + r.choice([self.words(1, 5), self.sentence(3, 15)])
            return self.element("foot", ["footer", "footer", "div"], r.choice([p(line), p(line) + self.links(2, 6), self.links(2, 6) + p(line)]), "rest")
        if kind == "side":
            body = r.choice([f"<h3>{self.words(1, 4)}</h3>", f"<h2>{self.words(1, 4)}</h2>", ""]) + r.choice([self.links(), p(self.prose(1, 3)), "".join(f"<h4>{self.link(7)}</h4><p>{self.sentence()}</p>" for _ in range(r.randint(1, 4)))])
            return self.element("side", ["aside", "aside", "div", "section"], body, "rest")
        if kind == "ad":
            return self.element("ad", ["div", "div", "aside", "section"], r.choice([p(self.prose(1, 3)), p(self.words(1, 6)), p(self.link()) + p(self.prose(1, 2)), p("Advertisement") + p(self.words(2, 8))]), "rest")
        if kind == "note":
            return self.element("note", ["div", "div", "section", "dialog", "aside"], p(r.choice(["We use cookies. ", "", "Cookie consent: ", ""]) + self.prose(1, 3)) + r.choice(["", f"<button>{self.words(1, 2)}</button>"]), "rest")
        if kind == "form":
            body = f"<label>{self.words(1, 3)}</label><input name=q><select><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button>"
            return self.element("form", ["form", "form", "div"], r.choice(["", f"<h3>{self.words(2, 5)}</h3>", p(self.prose(1, 2))]) + (body if r.random() < 0.5 else f"<form data-part=rest>{body}</form>"), "rest")
        return self.element("share", ["div", "ul"], r.choice([self.links(2, 5), p(self.words(1, 3))]), "rest")

    def replies(self) -> str:
        r = self.rng
        tag, name = r.choice(["li", "div", "article", "p", "section", "div"]), r.choice(["comment", "reply", "response", "comment-body", "post", "message", ""])
        one = lambda: f'<{tag}{f" class={name}" if name else ""}>' + r.choice([f"<h4>{self.words(1, 2)}</h4>", f"<b>{self.words(1, 2)}</b>: ", f"<cite>{self.words(1, 2)}</cite> <time>2 days ago</time>", ""]) + (self.prose(1, 4) if tag == "p" else f"<p>{self.prose(1, 4)}</p>") + f"</{tag}>"
        body = r.choice([f"<h2>{r.randint(1, 9)} comments</h2>", f"<h3>{self.words(1, 3)}</h3>", ""]) + "".join(one() for _ in range(r.randint(1, 6))) + (self.rest("form") if r.random() < 0.2 else "")
        return self.element("reply", ["section", "div", "div", "ul", "ol", "aside"], body, "reply")

    def inner(self) -> str:
        """The article's own blocks, with foreign regions between some."""
        r = self.rng
        title = f"<h1>{self.words(2, 12)}</h1>" if r.random() < 0.85 else ""
        if r.random() < 0.2 and title:
            title = f"<header>{title}" + r.choice(["", f"<p class=byline>{self.words(2, 6)}</p>", f"<time>{self.words(1, 3)}</time>"]) + "</header>"
        out, tag = [title], r.choice(["p", "p", "p", "p", "div"])
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            x = r.random()
            if x < 0.68:
                out.append(f"<{tag}>{self.prose()}" + (f"</{tag}>" if tag == "div" or r.random() < 0.8 else ""))
            elif x < 0.76:
                out.append(f"<{tag}>{r.choice([self.words(1, 4), self.words(1, 4), *_TELLING])}{r.choice(['.', '', ':'])}</{tag}>")
            elif x < 0.82:
                out.append(f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{self.words(1, 8)}</{h}>")
            elif x < 0.87:
                out.append("<ul>" + "".join(f"<li>{r.choice([self.sentence, self.link, lambda: self.words(1, 6)])()}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.9:
                out.append(f"<blockquote>{r.choice(['<p>', ''])}{self.prose(1, 3)}</blockquote>")
            elif x < 0.93:
                out.append(f"<figure><img src=a.png><figcaption>{self.words(3, 12)}</figcaption></figure>")
            elif x < 0.96:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            else:
                out.append(f"<pre>{self.words(3, 20)}</pre>")
        for kind in r.choices(["ad", "side", "share", "form", "note", "nav"], k=r.choice([0, 0, 1, 2, 3])):
            out.insert(r.randint(1, len(out)), self.rest(kind))
        if r.random() < 0.12:
            out.append(f"<footer data-part=rest>{r.choice([self.links(2, 4), self.words(2, 9)])}</footer>")
        return "".join(out)

    def page(self) -> str:
        r = self.rng
        inner, late = self.inner(), self.replies() if r.random() < 0.4 else ""
        if r.random() < 0.4:
            inner, late = inner + late, ""
        own = lambda tag, attr="": f"<{tag}{attr} data-part=main>{inner}</{tag}>"
        name = f' {r.choice(["class", "id"])}="{r.choice(_NAMES["main"])}"'
        if r.random() < 0.06:  # nothing but the article, or its text
            return r.choice([f"<html><body data-part=main>{inner}{late}</body></html>", f"<body data-part=main>{self.prose()}", f"<body data-part=main>{inner}</body>", f"<body data-part=main><div>{inner}</div></body>"])
        body = r.choice([
            lambda: own("article"), lambda: own("article", name), lambda: own("article"), lambda: own("main"), lambda: f"<main>{own('article')}{late}</main>", lambda: own("div", name), lambda: own("div", name), lambda: own("section", name),
            lambda: f"<div{name}><div>{own('div', name)}</div></div>", lambda: own("div"), lambda: own("div", ' role="main"'), lambda: f"<table><tr><td>{self.rest('nav')}</td>{own('td')}</tr></table>",
        ])()
        late = "" if late and late in body else late
        before = "".join(map(self.rest, [k for k in ("note", "head", "nav", "form", "ad", "side") if r.random() < (0.6 if k in ("head", "nav") else 0.25)]))
        after = late + "".join(map(self.rest, [k for k in ("share", "side", "nav", "form", "ad", "note", "foot") if r.random() < (0.7 if k == "foot" else 0.25)]))
        wrap = r.choice(["", "", '<div class="container">', '<div id="page">', '<div class="wrapper">', "<div>"])
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head><body>{wrap}{before}{body}{after}{'</div>' if wrap else ''}</body></html>"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """Labelled pages in the usual layouts, of invented words in eight languages' letters; the same for the same seed."""
    return [_Writer(random.Random(f"{seed} {k}")).page() for k in range(n)]


@lru_cache(maxsize=2)
def default_model(n: int = PAGES, seed: int = SEED) -> Crf:
    return fit(labelled_pages(n, seed))


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of pages(page_id, url, html): the blocks labelled article text, joined by line ends.

    White space inside a block becomes one space. Null or empty html gives an empty text, as does a page without an
    article; page_id and url are passed as they are, repeated rows each give a row, pages are read whole however long,
    broken mark-up is taken as far as it goes; other columns are left out; an empty table gives no rows. The default model is
    fitted on PAGES labelled pages at the driver; a model has a row of weights for each feature of those."""
    model = model or default_model()
    held = pages.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches):
        crf = held.value
        for batch in batches:
            html = batch.column(2)
            for k in range(0, batch.num_rows, 64):
                texts = [crf.text(x) for x in html.slice(k, 64).to_pylist()]
                yield pa.record_batch([batch.column(0).slice(k, 64), batch.column(1).slice(k, 64), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    types = dict(pages.dtypes)
    return pages.select("page_id", "url", pages["html"].cast("string").alias("html")).mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: For pages whose article is one <article> without regions of other kinds, as in the tables at hand.
OP13_SQL = r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, url, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM a),
e AS (SELECT page_id, url, array_to_string(b, chr(10)) AS text FROM d) SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM e"""
