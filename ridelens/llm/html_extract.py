"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks in page order.  Every block becomes a
vector: its tag path (hashed tags, classes and ids), its hashed words, and a
few measures (length, links, punctuation, its container's share of the page,
agreement with the page's title).  A bidirectional LSTM in numpy reads the
whole sequence and labels every block, so that a block is judged by its
neighbourhood too.  The text of the blocks labelled as main text is the result.

There are no labelled pages, so the network learns from votes on the blocks of
a bounded sample (`fit_pages` pages, smallest hash of page_id first, of each at
most `FIT_BLOCKS` blocks in evenly spread windows): link density, the share of
text in the block's container, its place beside the densest container, the
title, prose, repetition on other pages of the sample, and the names in its
markup.  Expectation-maximisation estimates how far each voter can be trusted;
its posteriors are the labels.  Names are one voter and no input: paths are
swapped, masked and renamed at random while training, so that the network
knows markup the sample does not hold but can do without it.

Edge cases: null and empty pages, and pages without a block, give an empty
text; broken markup (unclosed or crossing tags, cut-off pages) is read as far
as it goes; a table without any block to learn from gives a model that keeps
all blocks; repeated rows are read one by one, and of differing pages of one
page_id the sample holds the one with the least digest; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import bounded_batches, pick, read_table, small_batches

# Element names by their treatment in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript svg math iframe object canvas".split())
HEAD = frozenset("head title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
# Names in tags, classes and ids that tell a block's role.
BOILER = frozenset("nav navbar navigation menu header masthead footer aside sidebar ad ads advert adverts "
                   "advertisement banner promo promotion sponsor sponsored cookie cookies consent notice "
                   "alert popup modal newsletter subscribe subscription form button select option textarea "
                   "label fieldset legend comment comments reply replies respond share sharing social related "
                   "recommended breadcrumb breadcrumbs pagination pager widget login signup search copyright "
                   "legal disclaimer toolbar skip".split())
CONTENT = frozenset("article articlebody main content post entry story prose".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)[^<>]*+>"
    r"|<[!?][^>]*+>", re.S | re.I)
ATTR = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
NAME = re.compile(r"[a-z]+")
PATH_DIM, WORD_DIM, HIDDEN = 128, 24, 16
MEASURES = 11
FIT_BLOCKS, WINDOW = 240, 48
HEADING_CHARS = 300
VOTERS = ("names", "links", "container", "beside", "title", "prose", "repeated")
DIM = PATH_DIM + WORD_DIM + MEASURES


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]  # names (tag, classes, ids) of the open elements
    link_chars: int
    title: frozenset[str]  # words of the page's title


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    heading: list[str] = []
    link, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal parts, links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, tuple(n for t, n in stack if t not in INLINE), min(links, len(text)), frozenset()))
        parts, links = [], 0

    def words(raw: str) -> None:
        nonlocal links
        if raw and stack and stack[-1][0] == "title":
            heading.append(html.unescape(raw))
        elif raw and not any(t in HEAD for t, _ in stack):
            decoded = html.unescape(raw)
            parts.append(decoded)
            if link:
                links += len(decoded)

    for m in TOKEN.finditer(page):
        words(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID and not (m["attrs"] or "").endswith("/"):
            if tag in ("p", "li", "td", "tr", "option") and stack:
                for k in range(len(stack) - 1, -1, -1):  # an open one ends here
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            if tag == "body":
                stack = [s for s in stack if s[0] not in HEAD]
            names = [tag]
            for a in ATTR.findall(m["attrs"] or ""):
                names += NAME.findall("".join(a).lower())
            stack.append((tag, tuple(names)))
        link = sum(t == "a" for t, _ in stack)
    words(page[at:])
    flush()
    title = frozenset("".join(heading).split())
    for b in out:
        b.title = title
    return out


def role(path: tuple[tuple[str, ...], ...]) -> int:
    """1: the innermost telling name is that of content, -1: of boilerplate, 0: none."""
    for names in reversed(path):
        if any(n in BOILER for n in names):
            return -1
        if any(n in CONTENT for n in names):
            return 1
    return 0


class Vectors(dict):
    """Hash buckets of words, kept between pages."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        b = self[word] = zlib.crc32(word.encode()) % WORD_DIM
        return b


def add_name(path: np.ndarray, name: str, depth: int) -> None:
    """Add a tag, class or id to a path vector: two signed places, so that names
    seldom share both."""
    h = zlib.crc32(name.encode())
    path[h % PATH_DIM] += (1 if h & 0x10000 else -1) / (1 + depth)
    path[(h >> 20) % PATH_DIM] += (1 if h & 0x20000 else -1) / (1 + depth)


def cues(page_blocks: list[Block]) -> np.ndarray:
    """Per block: words, link share, punctuation a word, share of the page's text
    in its container, whether it stands between the first and the last block of
    the densest container, likeness to the title, share of the title in it.
    Link text does not make a container dense, and a block like the title counts
    as HEADING_CHARS more, so that a short article stands out too; the body's own children are containers by their markup."""
    out = np.zeros((len(page_blocks), 7), np.float32)
    places = [b.path if len(b.path) < 2 or b.path[-2][0] == "body" else b.path[:-1] for b in page_blocks]
    held: dict = {}
    for place, b in zip(places, page_blocks):
        words = set(b.text.split(" "))
        alike = b.title and len(b.title & words) >= 0.6 * len(b.title | words)
        held[place] = held.get(place, 0) + len(b.text) - b.link_chars + (HEADING_CHARS if alike else 0)
    total = max(1, sum(held.values()))
    densest = max(held, key=held.__getitem__, default=())
    inside = [i for i, place in enumerate(places) if place == densest]
    for i, b in enumerate(page_blocks):
        words = b.text.split(" ")
        common = len(b.title.intersection(words))
        out[i] = (len(words), b.link_chars / max(1, len(b.text)), sum(map(b.text.count, ".,;!?")) / len(words),
                  held[places[i]] / total, inside[0] <= i <= inside[-1],
                  common / max(1, len(b.title.union(words))) if common else 0, common / max(1, len(b.title)))
    return out


def votes(page_blocks: list[Block], c: np.ndarray) -> np.ndarray:
    """What each voter but the last (repetition, which needs other pages) says of
    each block: 1 main text, -1 not, 0 nothing."""
    words, links, marks, share, inside, likeness = c.T[:6]
    return np.column_stack([
        [role(b.path) for b in page_blocks],
        np.where(links > 0.5, -1, 0),
        np.where(share >= 0.5, 1, np.where(share <= 0.15, -1, 0)),
        np.where(inside > 0, 0, -1),
        np.where(likeness >= 0.6, 1, 0),
        np.where((words >= 20) & (marks > 0), 1, np.where(words <= 3, -1, 0))]).astype(np.int8)


def trusted(v: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Expectation-maximisation over the voters: the probability that each row of
    votes is of main text.  A vote never counts against its own claim."""
    patterns, back, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    p = 1 / (1 + np.exp(-patterns.sum(axis=1).astype(float)))
    says = [patterns == x for x in (-1, 0, 1)]
    for _ in range(rounds):
        yes = np.array([((n * p)[:, None] * s).sum(axis=0) + w for s, w in zip(says, (1, 1, 2))])
        no = np.array([((n * (1 - p))[:, None] * s).sum(axis=0) + w for s, w in zip(says, (2, 1, 1))])
        ratio = np.log(yes / yes.sum(axis=0)) - np.log(no / no.sum(axis=0))
        ratio[0], ratio[2] = np.minimum(ratio[0], 0), np.maximum(ratio[2], 0)
        prior = ((n * p).sum() + 1) / (n.sum() + 2)
        logit = np.log(prior / (1 - prior)) + sum((s * r).sum(axis=1) for s, r in zip(says, ratio))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p[back.ravel()]


def features(page_blocks: list[Block], buckets: Vectors) -> np.ndarray:
    out = np.zeros((len(page_blocks), DIM), np.float32)
    n, c = len(page_blocks), cues(page_blocks)
    known: dict = {}
    for i, b in enumerate(page_blocks):
        row = out[i]
        path = known.get(b.path)
        if path is None:
            path = np.zeros(PATH_DIM, np.float32)
            for depth, names in enumerate(reversed(b.path)):
                for name in names:
                    add_name(path, name, depth)
            known[b.path] = path
        row[:PATH_DIM] = path
        words = b.text.split(" ")
        count = np.bincount([buckets[w] for w in words], minlength=WORD_DIM)
        row[PATH_DIM:PATH_DIM + WORD_DIM] = count / np.sqrt((count * count).sum())
        row[PATH_DIM + WORD_DIM:] = (
            np.log1p(len(words)) / 4, c[i, 1], min(1.0, c[i, 2]), *c[i, 3:],
            i / max(1, n - 1), i == 0, i == n - 1, 1.0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """w, u, b: input, recurrent and bias weights of the two directions (gates
    input, forget, cell, output); v, c: the output layer."""
    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    v: np.ndarray
    c: np.ndarray

    @staticmethod
    def fresh(dim: int = DIM, hidden: int = HIDDEN, seed: int = 11) -> "Labeller":
        rng = np.random.default_rng(seed)

        def init(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        bias = np.zeros(4 * hidden)
        bias[hidden:2 * hidden] = 1
        return Labeller([init(dim, 4 * hidden) for _ in "fb"], [init(hidden, 4 * hidden) for _ in "fb"],
                        [bias.copy() for _ in "fb"], init(2 * hidden, 1), np.zeros(1))

    def weights(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.b, self.v, self.c]

    def _run(self, x: np.ndarray, mask: np.ndarray, d: int, trace: list | None) -> np.ndarray:
        """Hidden states of one direction; x: time, page, feature.  Steps beyond a
        page's end keep its state."""
        size = self.u[d].shape[0]
        h = np.zeros((x.shape[1], size))
        cell = np.zeros_like(h)
        out = np.zeros((x.shape[0], x.shape[1], size))
        pre = x @ self.w[d] + self.b[d]
        for t in range(x.shape[0]) if d == 0 else range(x.shape[0] - 1, -1, -1):
            z = pre[t] + h @ self.u[d]
            i, f = sigmoid(z[:, :size]), sigmoid(z[:, size:2 * size])
            g, o = np.tanh(z[:, 2 * size:3 * size]), sigmoid(z[:, 3 * size:])
            keep = mask[t][:, None]
            new = f * cell + i * g
            tanh = np.tanh(new)
            if trace is not None:
                trace.append((t, i, f, g, o, cell, tanh, h, keep))
            cell = np.where(keep, new, cell)
            h = np.where(keep, o * tanh, h)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, None) for d in (0, 1)], axis=2)
        return (both @ self.v + self.c)[:, :, 0]

    def gradients(self, x, mask, y, weight) -> tuple[float, list[np.ndarray]]:
        """Weighted cross entropy and its gradients by back-propagation in time."""
        traces: list[list] = [[], []]
        both = np.concatenate([self._run(x, mask, d, traces[d]) for d in (0, 1)], axis=2)
        p = sigmoid((both @ self.v + self.c)[:, :, 0])
        total = max(1.0, weight.sum())
        loss = -(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total
        dlogit = (weight * (p - y) / total)[:, :, None]
        dv, dc = (both * dlogit).sum(axis=(0, 1))[:, None], dlogit.sum(axis=(0, 1))
        dboth = dlogit @ self.v.T
        grads: dict[str, list] = {"w": [], "u": [], "b": []}
        for d in (0, 1):
            size = self.u[d].shape[0]
            dh, dcell = np.zeros((x.shape[1], size)), np.zeros((x.shape[1], size))
            dw, du, db = np.zeros_like(self.w[d]), np.zeros_like(self.u[d]), np.zeros_like(self.b[d])
            for t, i, f, g, o, before, tanh, h_before, keep in reversed(traces[d]):
                dh = dh + dboth[t, :, d * size:(d + 1) * size]
                a, s = np.where(keep, dh, 0), np.where(keep, dcell, 0)
                s = s + a * o * (1 - tanh * tanh)
                dz = np.concatenate([s * g * i * (1 - i), s * before * f * (1 - f),
                                     s * i * (1 - g * g), a * tanh * o * (1 - o)], axis=1)
                dw += x[t].T @ dz
                du += h_before.T @ dz
                db += dz.sum(axis=0)
                dh = np.where(keep, dz @ self.u[d].T, dh)
                dcell = np.where(keep, s * f, dcell)
            grads["w"].append(dw)
            grads["u"].append(du)
            grads["b"].append(db)
        return loss, [*grads["w"], *grads["u"], *grads["b"], dv, dc]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, feature) and the mask of real steps."""
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[:len(p), k] = p
        mask[:len(p), k] = True
    return x, mask


def renamed(rng: np.random.Generator, main: bool | None) -> np.ndarray:
    """A path vector of made-up markup that names the role, or (None) a name that
    tells nothing; an element of boilerplate may stand inside one of main text."""
    strange = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))]
    pools = [strange if main is None else sorted(CONTENT if main else BOILER),
             ["p", "div", "li", "span", "section", "h1", "h2"]]
    chain = [pools[0][rng.integers(len(pools[0]))]]
    if rng.random() < 0.5 or main is not False:
        chain.insert(0, pools[1][rng.integers(len(pools[1]))])
    if main is False and rng.random() < 0.5:
        content = sorted(CONTENT)
        chain.append(content[rng.integers(len(content))])
    out = np.zeros(PATH_DIM, np.float32)
    for depth, name in enumerate([*chain, "body", "html"]):
        add_name(out, name, depth)
        if 0 < depth < len(chain) and rng.random() < 0.5:  # as a class of a plain element
            add_name(out, "div", depth)
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 60, masked: float = 0.1,
          swapped: float = 0.15, named: float = 0.2, planted: float = 0.07, strange: float = 0.35, seed: int = 5) -> Labeller | None:
    """Adam on windows of blocks, as (features, probabilities of main text).  So
    that no site's own markup or order is learnt by heart, the path of a share
    of the blocks is masked, swapped with another block's or renamed, and the
    order of blocks is shuffled in a share of the windows.  Blocks planted with
    the markup of boilerplate teach sidebars and notices within main text."""
    rng = np.random.default_rng(seed)
    if not pages:
        return None
    x, mask = padded([f for f, _ in pages])
    y, weight = np.zeros(mask.shape), np.zeros(mask.shape)
    for k, (_, p) in enumerate(pages):
        y[:len(p), k] = p >= 0.5
        weight[:len(p), k] = np.abs(2 * p - 1)
    made = {main: np.stack([renamed(rng, main) for _ in range(2000)]) for main in (False, True, None)}
    pos, neg = (weight * y).sum(), (weight * (1 - y)).sum()
    weight *= np.where(y > 0, (pos + neg) / (2 * max(pos, 1)), (pos + neg) / (2 * max(neg, 1)))
    model = Labeller.fresh()
    first = [np.zeros_like(w) for w in model.weights()]
    second = [np.zeros_like(w) for w in model.weights()]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(x.shape[1])
        for s in range(0, len(order), 128):
            some, step = order[s:s + 128], step + 1
            part = x[:, some].copy()
            real, target, share = mask[:, some], y[:, some], weight[:, some]
            for j in np.flatnonzero(rng.random(len(some)) < swapped):
                n = int(real[:, j].sum())
                o = rng.permutation(n)
                part[:n, j], target[:n, j], share[:n, j] = part[o, j], target[o, j], share[o, j]
            spots = rng.random(part.shape[:2])
            other = part[rng.integers(0, part.shape[0], part.shape[:2]),
                         rng.integers(0, part.shape[1], part.shape[:2]), :PATH_DIM]
            part[:, :, :PATH_DIM] = np.where((spots > 1 - swapped)[:, :, None], other, part[:, :, :PATH_DIM])
            part[spots < masked, :PATH_DIM] = 0
            for main in (False, True):
                at = (spots >= masked) & (spots < masked + named) & ((target > 0) == main)
                part[at, :PATH_DIM] = made[main][rng.integers(0, 2000, int(at.sum()))]
            at = (spots >= masked + named) & (spots < masked + named + planted)
            part[at, :PATH_DIM], target[at] = made[False][rng.integers(0, 2000, int(at.sum()))], 0
            at = (spots >= masked + named + planted) & (spots < masked + named + planted + strange)
            part[at, :PATH_DIM] = made[None][rng.integers(0, 2000, int(at.sum()))]
            _, grads = model.gradients(part, real, target, share)
            norm = np.sqrt(sum((g * g).sum() for g in grads))
            for w, g, m1, m2 in zip(model.weights(), grads, first, second):
                g = g * min(1.0, 5 / max(norm, 1e-9))
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                w -= 0.01 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return model


def fit_labeller(pages: DataFrame, fit_pages: int = 300) -> Labeller | None:
    """Trained on the blocks of at most `fit_pages` pages: the tasks cut and vote,
    and vectors of at most FIT_BLOCKS blocks a page reach the driver."""
    def cut(batches):
        buckets = Vectors()
        for batch in batches:
            for page_id, page in zip(batch.column("page_id").to_pylist(), batch.column("html")):
                found = blocks(page.as_py())
                x, v = features(found, buckets), votes(found, cues(found)) if found else None
                texts = [zlib.crc32(b.text.encode()) for b in found]
                whole = zlib.crc32("\n".join(b.text for b in found).encode())
                starts = range(0, len(found), WINDOW)
                most = FIT_BLOCKS // WINDOW
                for k in sorted({j * len(starts) // most for j in range(most)}) if starts else ():
                    some = slice(k * WINDOW, (k + 1) * WINDOW)
                    yield pa.RecordBatch.from_pydict({
                        "page_id": [page_id], "window": pa.array([k], pa.int32()), "whole": pa.array([whole], pa.int64()),
                        "x": [x[some].tobytes()], "votes": [v[some].tobytes()],
                        "texts": pa.array([texts[some]], pa.list_(pa.int64()))})

    source = pick(pages, page_id="long", html="string").where("html is not null")
    ids = source.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(fit_pages)
    sample = (source.join(F.broadcast(ids), "page_id").groupBy("page_id")
              .agg(F.min_by("html", F.struct(F.xxhash64("html"), F.length("html"))).alias("html")))
    with small_batches(pages.sparkSession):
        rows = sorted(sample.mapInArrow(cut, "page_id long, window int, whole long, x binary, votes binary, "
                                             "texts array<long>").collect(), key=lambda r: (r["page_id"], r["window"]))
    if not rows:
        return None
    holders: dict[int, set[int]] = {}  # copies of a whole page count as one
    for r in rows:
        for t in r["texts"]:
            holders.setdefault(t, set()).add(r["whole"])
    cast = np.concatenate([np.frombuffer(r["votes"], np.int8).reshape(-1, len(VOTERS) - 1) for r in rows])
    repeated = np.array([-1 if len(holders[t]) >= 3 else 0 for r in rows for t in r["texts"]], np.int8)
    p = trusted(np.column_stack([cast, repeated]))
    ends = np.cumsum([len(r["texts"]) for r in rows])[:-1]
    return train([(np.frombuffer(r["x"], np.float32).reshape(-1, DIM), q) for r, q in zip(rows, np.split(p, ends))])


def label(model: Labeller | None, pages: list[list[Block]], buckets: Vectors) -> Iterator[list[bool]]:
    """For every page, whether each block is main text; pages of similar length
    are read together."""
    keep: list[list[bool]] = [[True] * len(p) for p in pages]
    if model is not None:
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        while order:
            steps = len(pages[order[0]])
            take = next((j for j, k in enumerate(order) if len(pages[k]) > steps + 8 + steps // 4
                         or j * steps > 20_000), len(order))
            group, order = order[:max(1, take)], order[max(1, take):]
            x, mask = padded([features(pages[k], buckets) for k in group])
            scores = model.logits(x, mask)
            for j, k in enumerate(group):
                keep[k] = (scores[:len(pages[k]), j] >= 0).tolist()
    yield from keep


def extract_text(pages: DataFrame, model: Labeller | None) -> DataFrame:
    """page_id, url, text, n_blocks, n_kept."""
    bounded_batches(pages.sparkSession)

    def extract(batches):
        buckets = Vectors()
        for batch in batches:
            cut = [blocks(x.as_py() or "") for x in batch.column("html")]
            kept = list(label(model, cut, buckets))
            texts = [" ".join(b.text for b, k in zip(p, ks) if k) for p, ks in zip(cut, kept)]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_blocks": pa.array([len(p) for p in cut], pa.int64()),
                "n_kept": pa.array([sum(k) for k in kept], pa.int64())})

    return pick(pages, page_id="long", url="string", html="string").mapInArrow(
        extract, "page_id long, url string, text string, n_blocks long, n_kept long")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract_text(pages, fit_labeller(pages)).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
