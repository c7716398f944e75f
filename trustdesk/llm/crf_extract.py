"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A leaf block is text between two boundaries of block elements; inline elements and line breaks do not end it. Each
block is described by the tags, classes, ids and roles of its ancestors and by its text. The field scores a label
(article or other) from these features and from the label before, is trained on labelled pages by gradient ascent on
the conditional likelihood, and the best labelling of a page is found by Viterbi's algorithm.

Labelled pages are a bounded sample of pages that mark their article themselves (``article`` or ``main``), each also
without that mark, and a few written pages of other layouts (``labelled_pages``).
"""

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trustdesk.llm.common import column, map_arrow
from trustdesk.llm.labelled_pages import PAGES

#: Pages that the model learns from at most, and the longest of them in characters; longer ones teach nothing new.
TRAIN_PAGES, TRAIN_LENGTH = 200, 60_000
ROUNDS, STEP, DECAY = 120, 0.15, 0.02
#: Fixed values of HTML: elements whose text is not text of the page, those without an end, and those in a line.
RAW = "script|style|template|noscript|title|textarea|iframe|svg|math"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
#: Elements that the start of another one ends, as in HTML: p by any block, list and table parts by their like.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
TOKEN = (rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
         r"|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z|[^<]+|<")
MADE = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])
TRUTH = "data-article"


class Block:
    __slots__ = ("text", "path", "linked", "tag")

    def __init__(self, text, path, linked):
        self.text, self.path, self.linked = text, path, linked


def leaf_blocks(page: str) -> list:
    """Leaf blocks with text, in page order. ``path`` lists the open elements as (tag, names); a page may be broken."""
    stack, out, parts, state = [], [], [], {"linked": 0, "path": ()}

    def close():
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, state["path"], state["linked"] / max(1, len("".join(parts).strip()))))
        parts.clear()
        state["linked"] = 0

    for m in re.finditer(TOKEN, page, re.I | re.S):
        token = m[0]
        if m[3] is None:
            if token[0] != "<" or token == "<":
                text = html.unescape(token)
                if not parts or not "".join(parts).strip():
                    state["path"] = tuple(stack)
                parts.append(text)
                if any(tag == "a" for tag, _ in stack):
                    state["linked"] += len(text.strip())
            elif m[1] is not None and m[1].lower() != "title":
                parts.append(" ")
            continue
        tag, ends = m[3].lower(), bool(m[2])
        if tag not in INLINE:
            close()
        elif tag == "br":
            parts.append(" ")
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID:
            if tag not in INLINE:
                ended = ENDS.get(tag, set()) | {"p"}
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ended:
                        del stack[i:]
                    elif stack[i][0] not in INLINE:
                        break
            stack.append((tag, names_of(m[4])))
    close()
    return out


def names_of(attributes: str) -> tuple:
    """Words of the class, id and role of an element, and whether it is marked as article in a labelled page."""
    found = re.findall(r"""\b(class|id|role|data-article)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", attributes, re.I)
    words = []
    for name, *values in found:
        words += [TRUTH] if name.lower() == TRUTH else re.findall("[a-z]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", "".join(values)).lower())
    return tuple(words)


def bucket(n, edges):
    return sum(n >= e for e in edges)


def features(blocks) -> list:
    """Names of the features of each block."""
    out = []
    for i, b in enumerate(blocks):
        words = b.text.split()
        n = len(words)
        own = {"bias", f"words:{bucket(n, (2, 4, 8, 16, 32, 64))}", f"linked:{bucket(b.linked, (0.01, 0.3, 0.7, 0.95))}",
               f"stop:{b.text[-1] in '.!?…:;\"”'}", f"commas:{bucket(b.text.count(','), (1, 3))}"}
        own |= {"first"} if i == 0 else set()
        own |= {"last"} if i == len(blocks) - 1 else set()
        own |= {"sign"} if re.search("[©®]|\\(c\\)", b.text) else set()
        outer = [tag for tag, _ in b.path if tag not in INLINE]
        own |= {f"tag:{t}" for t in outer if t not in ("html", "body")}
        own |= {f"name:{w}" for _, names in b.path for w in names if w != TRUTH}
        if outer:
            own.add(f"parent:{outer[-1]}")
        own.add(f"size:{bucket(n, (4, 16))}|linked:{bucket(b.linked, (0.3,))}")
        out.append(own)
    return out


def truth(blocks) -> list:
    """Labels of a labelled page: its marked elements; without a mark, its article or main less parts that are none."""
    marked = any(TRUTH in names for b in blocks for _, names in b.path)
    other = {"nav", "aside", "footer", "form", "header"}

    def label(b):
        if marked:
            return int(any(TRUTH in names for _, names in b.path))
        tags = [t for t, _ in b.path]
        inside = next((i for i, t in enumerate(tags) if t in ("article", "main")), None)
        return int(inside is not None and not other & set(tags[inside:]))

    return [label(b) for b in blocks]


class Field:
    """Weights of a linear-chain conditional random field with two labels."""

    def __init__(self, index, weights, moves):
        self.index, self.weights, self.moves = index, weights, moves

    def scores(self, rows):
        get, out = self.index.get, np.zeros((len(rows), 2))
        for i, row in enumerate(rows):
            out[i] = self.weights[[k for k in map(get, row) if k is not None]].sum(0)
        return out

    def decode(self, rows) -> list:
        """Most likely labels by Viterbi; article last among equals."""
        if not rows:
            return []
        emit, (from_other, from_article) = self.scores(rows).tolist(), self.moves.tolist()
        best, back = emit[0], []
        for e in emit[1:]:
            step, choice = [0.0, 0.0], [0, 0]
            for label in (0, 1):
                a, b = best[0] + from_other[label], best[1] + from_article[label]
                choice[label], step[label] = (1, b + e[label]) if b > a else (0, a + e[label])
            back.append(choice)
            best = step
        label = int(best[1] > best[0])
        path = [label]
        for choice in reversed(back):
            label = choice[label]
            path.append(label)
        return path[::-1]


def train(pages) -> Field:
    """Field of most likely labels for ``pages``, pairs of feature rows and labels; all pages advance together."""
    pages = [p for p in pages if p[0]]
    index = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
    longest = max((len(rows) for rows, _ in pages), default=1)
    n = len(pages)
    at = [(p, t, index[f]) for p, (rows, _) in enumerate(pages) for t, row in enumerate(rows) for f in row]
    page, place, feature = np.array(at).T if at else np.zeros((3, 0), int)
    flat = page * longest + place
    real, labels = np.zeros((n, longest)), np.zeros((n, longest), int)
    for p, (rows, y) in enumerate(pages):
        real[p, :len(rows)], labels[p, :len(rows)] = 1, y
    gold = np.eye(2)[labels] * real[..., None]
    both = real[:, 1:] * real[:, :-1]
    gold_moves = np.einsum("pti,ptj,pt->ij", gold[:, :-1], gold[:, 1:], both)
    weights, moves = np.zeros((len(index), 2)), np.zeros((2, 2))
    sums = np.zeros_like(weights), np.zeros_like(moves)
    for _ in range(ROUNDS):
        emit = np.stack([np.bincount(flat, weights[feature, k], n * longest) for k in (0, 1)], 1).reshape(n, longest, 2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = emit[:, t] + np.logaddexp(forward[:, t - 1, :1] + moves[0], forward[:, t - 1, 1:] + moves[1])
            forward[:, t] = np.where(real[:, t, None] > 0, new, forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            ahead = emit[:, t + 1] + backward[:, t + 1]
            new = np.stack([np.logaddexp(moves[i, 0] + ahead[:, 0], moves[i, 1] + ahead[:, 1]) for i in (0, 1)], 1)
            backward[:, t] = np.where(real[:, t + 1, None] > 0, new, 0)
        chance = np.exp(forward + backward - total[:, None, None]) * real[..., None]
        pair = np.exp(forward[:, :-1, :, None] + moves + (emit + backward)[:, 1:, None, :] - total[:, None, None, None])
        step = np.stack([np.bincount(feature, (gold - chance).reshape(-1, 2)[flat, k], len(index)) for k in (0, 1)], 1)
        for value, slope, seen in ((weights, step, sums[0]),
                                   (moves, gold_moves - (pair * both[..., None, None]).sum((0, 1)), sums[1])):
            slope = slope / max(n, 1) - DECAY / max(n, 1) * value
            seen += slope ** 2
            value += STEP * slope / np.sqrt(seen + 1e-8)
    return Field(index, weights, moves)


def without_marks(rows):
    """Features of the same page if its layout did not name the article."""
    mark = {"tag:article", "tag:main", "parent:article", "parent:main"}
    return [row - mark for row in rows]


def fit(pages: DataFrame, body="html", most=TRAIN_PAGES) -> Field:
    """A field trained on the written pages and on up to ``most`` of ``pages`` that mark their article.

    Training reads these pages only; it runs once on the driver, on a bounded sample.
    """
    marked = pages.where(column(body).rlike("(?i)<(article|main)[\\s>]") & (F.length(column(body)) <= TRAIN_LENGTH))
    labelled = []
    for text in [*PAGES, *[r["page"] for r in marked.select(column(body).alias("page")).limit(most).collect()]]:
        blocks = leaf_blocks(text)
        rows, labels = features(blocks), truth(blocks)
        labelled += [(rows, labels), (without_marks(rows), labels)]
    return train(labelled)


def extract(pages: DataFrame, field: Field, body="html", keep=None) -> DataFrame:
    """``pages`` with ``text``, the article's blocks joined by line feeds, and ``n_chars``, its code points.

    A null or empty page, and one without an article, has an empty text. Columns of these names are replaced. One
    pass without a shuffle; the field is a few kilobytes.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def start():
        field = shared.value

        def one(page):
            blocks = leaf_blocks(page or "")
            return "\n".join(b.text for b, y in zip(blocks, field.decode(features(blocks)), strict=True) if y)

        def step(bodies):
            texts = [one(p) for p in bodies.to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return step

    return map_arrow(pages, [column(body)], MADE, start, keep)
