"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: the text between two block-level boundaries, with the tags
and class words of its ancestors. Features of tags, class words and text feed a two-label
chain (article or not), trained by gradient ascent on labelled pages and decoded by Viterbi.
Labels come from pages whose mark-up names its article, seen as they are and with that
mark-up made weaker, and from built-in page skeletons.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lagline.llm.kit import map_rows

TRAIN_PAGES = 150  # bound of the labelled sample
ROUNDS = 120
FEATURES = 1 << 12  # hashed feature space

# HTML's void, raw-text and block-level elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe textarea title".split())
INERT = set("template svg math object select canvas audio video".split())  # hidden up to their end or their parent's
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option
    p pre section summary table tbody td tfoot th thead tr ul""".split())
#: A start tag that ends an open element of the same kind first.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = set("ul ol table dl div article section main aside nav body form td th blockquote header footer".split())
P_ENDS = BLOCK - {"p", "html", "head", "body", "button", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "option", "optgroup"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)|[^=>]++|=)*+)>|<[!?/][^>]*>""", re.S)
NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s>=]|\Z)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WHITE = re.compile(r"\s+")

FOR = set("article content post entry story body main text hentry blog".split())
AGAINST = set("""ad ads advert advertisement sponsor sponsored promo banner nav navigation menu breadcrumb breadcrumbs header masthead
    footer foot sidebar side aside widget related recommended share social cookie cookies consent notice gdpr alert popup modal overlay
    comment comments reply respond disqus form login signup subscribe newsletter search copyright legal pagination pager tags meta
    toolbar""".split())
KNOWN = FOR | AGAINST


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]  # of its ancestors, each once, the innermost last
    names: frozenset[str]  # those of its ancestors' names that are in FOR or AGAINST
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. White space inside a block, line breaks too, becomes one space.

    Open elements are known by tag and name, so work follows the page's length at any depth.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    places: dict[str, list[int]] = {}  # where in the stack a tag is open
    scopes: list[int] = []
    told: dict[str, int] = {}  # open elements by name
    parts: list[str] = []
    at, linked, anchors, hidden = 0, 0, 0, 0
    inert = -1  # place in the stack of the outermost open one of INERT

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            parts.append(raw)
            linked += len(raw) * (anchors > 0)

    def close() -> None:
        nonlocal linked
        text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            inner = stack[-1][0] if stack else None
            out.append(Block(text, (*(t for t in places if t != inner), *([inner] if stack else [])), frozenset(told), linked))
        parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal hidden, inert
        if to <= inert:
            inert = -1
        for tag, names in reversed(stack[to:]):
            hidden -= "\0" in names
            if len(places[tag]) == 1:
                del places[tag]
            else:
                places[tag].pop()
            if tag in SCOPE:
                scopes.pop()
            for name in names & KNOWN:
                told[name] -= 1
                if not told[name]:
                    del told[name]
        del stack[to:]

    def push(tag: str, names: frozenset[str]) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        for name in names & KNOWN:
            told[name] = told.get(name, 0) + 1
        stack.append((tag, names))

    n = len(page)
    last = page.rfind(">") + 1  # no tag ends behind it
    while at < n:
        start = page.find("<", at, last)
        if start < 0:
            comment = page.find("<!--", at)
            add(page[at:] if comment < 0 else page[at:comment])
            break
        match = TAG.match(page, start)
        add(page[at:start + (match is None)])
        if match is None:
            at = start + 1
            continue
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in BLOCK or tag in INERT:
                k = places[tag][-1] if tag in places else -1
                if 0 <= k < inert:
                    pop(inert)
                if tag in BLOCK and inert < 0:
                    close()
                if k >= 0:
                    pop(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in INERT:
            if not match[3].endswith("/") or tag not in ("svg", "math"):
                if inert < 0:
                    inert = len(stack)
                push(tag, frozenset({"\0"}))
                hidden += 1
            continue
        if inert >= 0:
            if tag in BLOCK and tag not in VOID:
                push(tag, frozenset())
            continue
        if tag == "br" or tag in ("img", "wbr"):
            add("\n" if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if tag == "a":
            anchors = 1
            continue
        if tag not in BLOCK:
            continue
        close()
        anchors = 0
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in P_ENDS else set())
        ended = max((places[t][-1] for t in ends if t in places), default=-1)
        if ended >= 0 and ended >= (scopes[-1] if scopes else 0):
            pop(ended)
        names = frozenset(w for g in NAMES.findall(match[3]) for w in re.split(r"[^a-z]+", "".join(g).lower()) if w) if match[3] else frozenset()
        if match[3] and HIDDEN.search(match[3]):
            names |= {"\0"}
            hidden += 1
        push(tag, names)
    close()
    return out


def features(found: list[Block]) -> list[list[str]]:
    rows = []
    total = len(found)
    for k, b in enumerate(found):
        words = b.text.split(" ")
        share = b.linked / max(1, len(b.text))
        f = ["bias", f"tag:{b.tags[-1] if b.tags else ''}"]
        f += [f"in:{t}" for t in set(b.tags)]
        f += [f"for:{w}" for w in b.names & FOR] + [f"against:{w}" for w in b.names & AGAINST]
        f += ["named for"] * bool(b.names & FOR) + ["named against"] * bool(b.names & AGAINST)
        f += [f"words:{min(7, len(words).bit_length())}", f"links:{int(share * 4)}"]
        f += ["sentence"] * (b.text[-1] in ".!?…。\"'”)") + ["mark"] * ("©" in b.text or "·" in b.text or "|" in b.text)
        f += ["first"] * (k == 0) + ["last"] * (k == total - 1)
        f += [f"long:{len(words) >= 12}:{share > 0.5}", f"short last:{k >= total - 2 and len(words) < 15}"]
        rows.append(f)
    return rows


def slots(rows: list[list[str]]) -> list[np.ndarray]:
    return [np.array([_slot(f) for f in row]) for row in rows]


def _slot(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h % FEATURES


@dataclass
class Chain:
    """Weights by feature and label, between labels, and at both ends. Label 1 is the article."""

    weights: np.ndarray
    steps: np.ndarray
    ends: np.ndarray

    def scores(self, page: list[np.ndarray]) -> np.ndarray:
        out = np.array([self.weights[s].sum(axis=0) for s in page])
        out[0] += self.ends[0]
        out[-1] += self.ends[1]
        return out

    def decode(self, page: list[np.ndarray]) -> list[int]:
        """The best labels (Viterbi); of equal paths the one with lower labels."""
        if not page:
            return []
        rows, (s00, s01), (s10, s11) = self.scores(page).tolist(), *self.steps.tolist()
        back, (a, b) = [], rows[0]
        for x, y in rows[1:]:
            back.append((int(b + s10 > a + s00), int(b + s11 > a + s01)))
            a, b = x + max(a + s00, b + s10), y + max(a + s01, b + s11)
        path = [int(b > a)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


def train(pages: list[tuple[list[np.ndarray], list[int]]], rounds: int = ROUNDS, rate: float = 0.3, shrink: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by adaptive gradient steps; forward and backward sums over all pages at once."""
    chain = Chain(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros((2, 2)))
    pages = [(x, y) for x, y in pages if x]
    if not pages:
        return chain
    count, most = len(pages), max(len(x) for x, _ in pages)
    rows = [(p, t, s) for p, (x, _) in enumerate(pages) for t, s in enumerate(x)]
    owner = np.repeat(np.array([p * most + t for p, t, _ in rows]), [len(s) for _, _, s in rows])
    slot = np.concatenate([s for _, _, s in rows])
    size = np.array([len(x) for x, _ in pages])
    live = np.arange(most)[None, :] < size[:, None]
    gold = np.zeros((count, most, 2))
    for p, (_, y) in enumerate(pages):
        gold[p, np.arange(len(y)), y] = 1
    gold_steps = np.einsum("pti,ptj->ij", gold[:, :-1], gold[:, 1:])
    last = np.arange(count), size - 1
    memory = [np.full_like(w, 1e-8) for w in (chain.weights, chain.steps, chain.ends)]
    plus = np.logaddexp.reduce
    for _ in range(rounds):
        emit = np.zeros((count * most, 2))
        np.add.at(emit, owner, chain.weights[slot])
        emit = emit.reshape(count, most, 2)
        emit[:, 0] += chain.ends[0]
        emit[last] += chain.ends[1]
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, most):
            ahead[:, t] = np.where(live[:, t, None], emit[:, t] + plus(ahead[:, t - 1, :, None] + chain.steps, axis=1), ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            behind[:, t] = np.where(live[:, t + 1, None], plus(chain.steps + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2), 0)
        norm = plus(ahead[:, -1], axis=1)
        node = np.where(live[:, :, None], np.exp(ahead + behind - norm[:, None, None]), 0)
        edge = ahead[:, :-1, :, None] + chain.steps + (emit + behind)[:, 1:, None, :] - norm[:, None, None, None]
        edge = np.where(live[:, 1:, None, None], np.exp(np.minimum(edge, 0)), 0)
        miss = gold - node
        flat = miss.reshape(-1, 2)
        grown = np.zeros_like(chain.weights)
        np.add.at(grown, slot, flat[owner])
        ends = np.stack([miss[:, 0].sum(axis=0), miss[last].sum(axis=0)])
        for w, g, m in zip((chain.weights, chain.steps, chain.ends), (grown, gold_steps - edge.sum(axis=(0, 1)), ends), memory):
            g = g - shrink * w * count
            m += g * g
            w += rate * g / np.sqrt(m)
    return chain


# Labelled skeletons: mark-up that names its parts less plainly than <article>. {t} is a long text, {s} a short one.
SKELETONS = (
    ("<header><h2>{s}</h2><nav><a href=x>{s}</a></nav></header>", "<main><h1>{s}</h1><p>{t}</p><p>{t}</p><ul><li>{t}</li></ul></main>",
     "<aside><h3>{s}</h3><ul><li><a href=x>{s}</a></li></ul></aside><footer><p>&copy; {s}</p></footer>"),
    ("<div class='top header'><a href=x>{s}</a></div><div class='cookie-notice'><p>{t}</p><button>ok</button></div>",
     "<div class='post-content'><h1>{s}</h1><p>{t}</p><blockquote>{t}</blockquote><p>{s}.</p></div>",
     "<div class='sidebar'><p>{s}</p></div><section id=comments class=comments><h3>{s}</h3><div class=comment><p>{t}</p></div></section><div class=footer>{s} &middot; {s}</div>"),
    ("<ul class=menu><li><a href=x>{s}</a></li><li><a href=y>{s}</a></li></ul><div id=banner class=ad>{s}</div>",
     "<div id=main><h1>{s}</h1><div>{t}</div><div>{t}</div><table><tr><td>{s}</td><td>{s}</td></tr></table></div>",
     "<form class=newsletter><p>{s}</p><label>{s}</label></form><div class='related'><a href=x>{s}</a><a href=y>{s}</a></div><div>&copy; {s}</div>"),
    ("<table><tr><td><a href=x>{s}</a> | <a href=y>{s}</a></td></tr></table>", "<h1>{s}</h1><p>{t}</p><p>{t}</p><p>{t}</p>", "<p><a href=x>{s}</a> &middot; <a href=y>{s}</a></p><p>&copy; {s}</p>"),
    ("<nav><ul><li><a href=x>{s}</a></li></ul></nav><div class=promo><p>{t}</p></div>",
     "<article><header><h1>{s}</h1></header><p>{t}</p><h2>{s}</h2><p>{t}</p></article>",
     "<div class='article-comments'><article class=comment><p>{t}</p></article></div><aside>{t}</aside><footer>{s}</footer>"),
)
MARK = "\x01"


def skeleton_pages(sentences: list[str]) -> list[tuple[str, list[int]]]:
    """Built-in pages with labels; a mark at a block's start tells article blocks apart."""
    out = []
    for k in range(8 * len(SKELETONS)):
        before, inside, after = SKELETONS[k % len(SKELETONS)]
        place = iter(range(k * 31, k * 31 + 999))
        text = lambda m: (" ".join(sentences[(next(place) * 7) % len(sentences)] for _ in range(2 + k % 3)) if m[0] == "{t}"
                          else " ".join(sentences[next(place) % len(sentences)].split(" ")[:2 + k % 4]).rstrip("."))
        fill = lambda part, mark: re.sub(r"\{[ts]\}", lambda m: mark + text(m), part)
        page = "<html><body>" + fill(before, "") + fill(inside, MARK) + fill(after, "") + "</body></html>"
        out.append((page.replace(MARK, ""), [int(MARK in b.text) for b in blocks(page)]))
    return out


def weaker(page: str, step: int) -> str:
    """The page with its naming elements made classes (1) or bare divisions (2)."""
    names = {"article": "content", "main": "main", "nav": "menu", "footer": "footer", "header": "header", "aside": "sidebar"}
    for tag, name in names.items():
        page = re.sub(rf"<{tag}\b", f'<div class="{name}"' if step == 1 else "<div", page, flags=re.I)
        page = re.sub(rf"</{tag}\s*>", "</div>", page, flags=re.I)
    return page


def labelled(pages: list[str]) -> list[tuple[list[np.ndarray], list[int]]]:
    """Training pages: those that name one article or main part, as they are and weakened, and the skeletons."""
    out, sentences = [], ["Words stand here in a row.", "Another plain sentence follows, with more words in it.", "It ends.", "Some of them are short, others somewhat longer than that."]
    for page in pages:
        if not re.search(r"<(article|main)\b", page, re.I):
            continue
        found = blocks(page)
        gold = [int(bool({"article", "main"} & set(b.tags)) and not {"nav", "aside", "form", "footer"} & set(b.tags) and not b.names & AGAINST) for b in found]
        sentences += [s for b, y in zip(found, gold) if y for s in re.findall(r"[^.]+\.", b.text)[:4]][:8]
        for step in range(3):
            version = blocks(weaker(page, step)) if step else found
            if len(version) == len(gold):
                out.append((slots(features(version)), gold))
    sentences = [s.strip() for s in sentences if s.strip()]
    # Few against many: skeletons weigh as much as the sample.
    built = [(slots(features(blocks(p))), y) for p, y in skeleton_pages(sentences)]
    return out + built * max(1, len(out) // (3 * len(built)))


def fit(pages: DataFrame, html_col: str = "html", limit: int = TRAIN_PAGES) -> Chain:
    """A chain from about `limit` distinct pages, chosen by hash and never over twice as many, and the skeletons."""
    chance = int(min(1.0, limit / max(pages.count(), 1)) * (1 << 30))
    chosen = F.pmod(F.xxhash64(html_col), F.lit(1 << 30)) < chance
    picked = pages.select(html_col).where(F.col(html_col).isNotNull() & chosen).dropDuplicates([html_col]).limit(2 * limit).collect()
    return train(labelled([r[0] for r in picked]))


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "")
    labels = chain.decode(slots(features(found)))
    return "\n".join(b.text for b, y in zip(found, labels) if y)


def extract(pages: DataFrame, html_col: str = "html", chain: Chain | None = None) -> DataFrame:
    """Add text and n_chars (code points) to every row: article blocks in page order, one a line.

    A null or empty page, or one without an article block, has an empty text. Rows are judged
    alone, so repeated rows agree. Columns called text or n_chars are replaced.
    """
    sent = pages.sparkSession.sparkContext.broadcast(chain or fit(pages, html_col))
    at = pages.columns.index(html_col)

    def run(chunk):
        texts = [main_text(p.as_py(), sent.value) for p in chunk.column(at)]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return map_rows(pages, run, [("text", T.StringType()), ("n_chars", T.LongType())], html_col)
