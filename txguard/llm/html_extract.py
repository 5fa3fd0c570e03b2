"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Each leaf block is main text or not. Features are its ancestors' tags and class
words and the shape of its text; neighbouring labels are scored together. Weights
come from labelled pages by penalised likelihood, pages are decoded by Viterbi.
The labelled pages are drawn from a table of page parts in which each part says
whether it is main text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.llm.html_blocks import Block, blocks

PAGES = 400
STEPS = 150
PENALTY = 0.5
SEED = 11

# Labelled page parts: markup around the text, and whether the text is main text. {n} blocks are put in place of *.
CONTAINERS = (
    '<article>*</article>', '<main>*</main>', '<main><article>*</article></main>', '<div class="article-body">*</div>',
    '<div id="content">*</div>', '<section class="post-content">*</section>', '<div class="entry"><div class="text">*</div></div>',
    '<div class="story">*</div>', '<td class="main">*</td>', '<div role="main">*</div>', '<div>*</div>', '<article class="post">*</article>',
)
MAIN_PARTS = (
    "<h1>{s}</h1>", "<h2>{s}</h2>", "<p>{l}</p>", "<p>{l}</p>", "<p>{l}", "<p>{s}</p>", "<p><b>{l}<br>", "<p>{w}</p>", "<p>{l}</p>",
    "<blockquote>{l}</blockquote>", "<ul><li>{s}</li><li>{s}</li></ul>", "<pre>{l}</pre>", "<table><tr><td>{w}</td><td>{s}</td></tr></table>",
    "<p>{l} <a href='/x'>{w}</a> {s}</p>", "<figure><figcaption>{s}</figcaption></figure>", "<div>{l}</div>", "<p>{t}</p>",
)
LINKS = "<li><a href='/x'>{w}</a></li>"
TOP_PARTS = (
    f"<nav><ul>{LINKS * 5}</ul></nav>", f"<header><h2>{{w}}</h2><ul>{LINKS * 3}</ul></header>", "<header><p>{s}</p></header>",
    f'<div class="menu">{LINKS * 4}</div>', '<div class="cookie-notice"><p>{s}</p><button>{w}</button></div>',
    '<div id="banner">{s}</div>', '<div class="ad">{s}</div>', '<div class="ad">{l}</div>', '<div class="breadcrumb"><a href="/">{w}</a> {w}</div>',
    '<form action="/s"><label>{w}</label><input name="q"><button>{w}</button></form>', '<div class="advert"><p>{l}</p></div>',
    '<div class="site-header"><p>{s}</p></div>', '<div class="notice">{s}</div>', '<div class="login"><a href="/l">{w}</a></div>',
    '<div role="alert">{s}</div>', '<div class="topbar"><a href="/">{w}</a></div>', '<noscript>{s}</noscript>', '<div class="consent">{l}</div>',
)
END_PARTS = (
    "<footer>&copy; {w} &middot; {s}</footer>", "<footer><p>{l}</p><a href='/'>{w}</a></footer>", f'<aside><h3>{{w}}</h3><ul>{LINKS * 3}</ul></aside>',
    '<aside><p>{l}</p></aside>', '<div class="sidebar"><p>{l}</p><p>{s}</p></div>', f'<div class="related"><h3>{{s}}</h3><ul>{LINKS * 3}</ul></div>',
    '<div class="comments"><h3>{w}</h3><div class="comment"><p>{l}</p></div><div class="comment"><p>{s}</p></div></div>',
    '<section id="comments"><ol><li class="comment"><p>{l}</p></li><li><p>{s}</p></li></ol></section>', '<div class="newsletter"><form><p>{s}</p><button>{w}</button></form></div>',
    '<div class="share"><a href="/f">{w}</a><a href="/t">{w}</a></div>', '<div id="footer">{s}</div>', '<div class="widget"><p>{s}</p></div>',
    '<div class="promo"><p>{l}</p></div>', '<div class="sponsored">{l}</div>', '<div class="copyright">{s}</div>', '<div class="reply"><p>{l}</p></div>',
    '<div class="popup modal"><p>{s}</p></div>', '<form><textarea>{s}</textarea><select><option>{w}<option>{w}</select></form>', '<div class="tags"><a href="/t">{w}</a></div>',
)
INNER_PARTS = (
    '<div class="ad">{s}</div>', "<aside>{s}</aside>", '<div class="advertisement"><p>{l}</p></div>', '<div class="related"><a href="/r">{s}</a></div>',
    '<div class="share"><a href="/f">{w}</a></div>', "<nav><a href='/p'>{w}</a></nav>", '<div class="comment"><p>{l}</p></div>', '<form><label>{s}</label></form>',
    '<section class="comments"><p>{l}</p></section>', "<header><p>{s}</p></header>", "<footer><p>{s}</p></footer>",
)


def _fill(part: str, rng: np.random.Generator, label: str) -> str:
    """Put random text for {w} a word or two, {s} a sentence, {l} a paragraph, {t} a table line; marked with its label."""

    def words(low: int, high: int) -> str:
        return " ".join("x" * size for size in rng.integers(2, 10, rng.integers(low, high)).tolist()).capitalize()

    makers = {
        "{w}": lambda: words(1, 3),
        "{s}": lambda: words(2, 14) + ("." if rng.random() < 0.7 else ""),
        "{l}": lambda: ". ".join(words(4, 14) + "," + words(1, 12) for _ in range(int(rng.integers(1, 9)))) + ".",
        "{t}": lambda: " | ".join(words(1, 2) for _ in range(int(rng.integers(2, 20)))) + " |",
    }
    for mark, make in makers.items():
        while mark in part:
            part = part.replace(mark, label + make(), 1)
    return part


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[list[tuple[Block, int]]]:
    """Blocks and labels of ``n`` pages drawn from the table of parts."""
    rng = np.random.default_rng(seed)
    pages = []
    for _ in range(n):
        top = "".join(_fill(str(rng.choice(TOP_PARTS)), rng, "\x02") for _ in range(rng.integers(0, 5)))
        end = "".join(_fill(str(rng.choice(END_PARTS)), rng, "\x02") for _ in range(rng.integers(0, 5)))
        inside = []
        for _ in range(rng.integers(1, 16)):
            inside.append(_fill(str(rng.choice(MAIN_PARTS)), rng, "\x01"))
            if rng.random() < 0.08:
                inside.append(_fill(str(rng.choice(INNER_PARTS)), rng, "\x02"))
        title = _fill("<title>{s}</title>", rng, "\x02")
        body = str(rng.choice(CONTAINERS)).replace("*", "".join(inside))
        page = f"<html><head>{title}<script>var a = '<p>';</script></head><body>{top}{body}{end}</body></html>"
        rows = []
        for block in blocks(page):
            label = int("\x01" in block.text)
            block.text = block.text.replace("\x01", "").replace("\x02", "")
            rows.append((block, label))
        pages.append(rows)
    return pages


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features of each block: ancestors' tags and class words, and the shape of the text."""
    rows = []
    for place, block in enumerate(page):
        text = block.text
        n = len(text)
        count = text.count(" ") + 1
        share = block.linked / n
        row = ["any", f"tag={block.tags[-1] if block.tags else ''}"]
        row += [f"in={t}" for t in set(block.tags)]
        row += [f"word={w}" for w in block.words]
        row.append(f"words={min(6, int(np.log2(count)))}")
        row.append(f"links={0 if share == 0 else 1 if share < 0.5 else 2}")
        row.append(f"end={text[-1] in '.!?:;,'}")
        row.append(f"commas={min(2, text.count(','))}")
        row.append(f"first={place == 0}")
        row.append(f"last={place == len(page) - 1}")
        if text[0] in "©®":
            row.append("rights")
        rows.append(row)
    return rows


@dataclass(frozen=True)
class Field:
    """Weights of a feature for main text (against not), by name, and of label pairs."""

    weights: dict[str, float]
    pairs: np.ndarray

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        get = self.weights.get
        score = [sum(get(f, 0.0) for f in row) for row in features(page)]
        (stay_out, enter), (leave, stay_in) = self.pairs.tolist()
        out, main = 0.0, score[0] if score else 0.0
        back = []
        for s in score[1:]:
            from_out = out + stay_out, main + leave
            from_main = out + enter, main + stay_in
            back.append((from_out[1] > from_out[0], from_main[1] > from_main[0]))
            out, main = max(from_out), max(from_main) + s
        labels = [int(main > out)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1] if page else []


def train(pages: list[list[tuple[Block, int]]], steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """Maximise the penalised likelihood by gradient steps with adapted sizes."""
    names: dict[str, int] = {}
    rows, where = [], []
    n, longest = len(pages), max(map(len, pages))
    labels = np.zeros((n, longest), int)
    mask = np.zeros((n, longest))
    for i, page in enumerate(pages):
        for j, row in enumerate(features([b for b, _ in page])):
            rows.append([names.setdefault(f, len(names)) for f in row])
            where.append(i * longest + j)
            labels[i, j], mask[i, j] = page[j][1], 1
    flat = np.concatenate([np.array(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    place = np.array(where)
    theta = np.zeros(len(names) + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    both = mask[:, 1:]
    seen = np.array([[(both * (labels[:, :-1] == a) * (labels[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    for step in range(1, steps + 1):
        scores = np.zeros(n * longest)
        scores[place] = np.bincount(owner, theta[flat], len(rows))
        main, pairs = scores.reshape(n, longest), theta[-4:].reshape(2, 2)
        node = np.stack([np.zeros_like(main), main], 2)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = node[:, 0]
        for j in range(1, longest):
            moved = np.logaddexp.reduce(ahead[:, j - 1, :, None] + pairs, axis=1) + node[:, j]
            ahead[:, j] = np.where(mask[:, j, None] > 0, moved, ahead[:, j - 1])
        behind = np.zeros((n, longest, 2))
        for j in range(longest - 2, -1, -1):
            moved = np.logaddexp.reduce(pairs + (node[:, j + 1] + behind[:, j + 1])[:, None, :], axis=2)
            behind[:, j] = np.where(mask[:, j + 1, None] > 0, moved, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        likely = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
        joint = ahead[:, :-1, :, None] + pairs + (node[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(joint, 0)) * both[:, :, None, None]).sum((0, 1))
        gap = (labels - likely).ravel()[place]
        slope = np.concatenate([np.bincount(flat, gap[owner], len(names)), (seen - expected).ravel()]) - penalty * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in names.items()}, theta[-4:].reshape(2, 2).copy())


def extracted(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(``page_id``, ``url``, ``text``, ``n_blocks``, ``n_main``) of every page, from its whole html.

    Main blocks are joined by a line feed in page order; a null or empty html, or
    one without main text, gives an empty text. Repeated rows are pages of their own.
    """
    field = model or train(labelled_pages())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, mains = [], [], []
            for page in batch.column("html"):
                found = blocks(page.as_py() or "")
                main = [b.text for b, label in zip(found, field.decode(found), strict=True) if label]
                texts.append("\n".join(main))
                sizes.append(len(found))
                mains.append(len(main))
            fields = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(mains, pa.int64())]
            yield pa.RecordBatch.from_arrays(fields, ["page_id", "url", "text", "n_blocks", "n_main"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_blocks long, n_main long")
