"""What pages say, from raw HTML: a small event-driven reader used by the Arrow operators over page tables."""

from __future__ import annotations

import json
from html.parser import HTMLParser

#: Elements whose text isn't content.
BOILERPLATE = {"script", "style", "nav", "footer", "header", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Class names of the public preview page of a channel.
CARD_TEXT, CARD_DATE = "tgme_widget_message_text", "tgme_widget_message_date"
CARD_FILE, CARD_FILE_NAME, CARD_FILE_EXTRA = (
    "tgme_widget_message_document_wrap", "tgme_widget_message_document_title", "tgme_widget_message_document_extra",
)


class Page(HTMLParser):
    """Facts of one page: text, links, headings, metas, times, JSON-LD scripts and message cards."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict | None]] = []  # open elements, and what collects their text
        self.text: list[str] = []
        self.links: list[dict] = []
        self.headings: list[dict] = []
        self.metas: dict[tuple[str, str], str] = {}
        self.times: list[str] = []
        self.scripts: list[dict] = []
        self.cards: list[dict] = []
        self.html, self.lines = html, [0, *(i + 1 for i, c in enumerate(html) if c == "\n")]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        classes, sink, card = a.get("class", "").split(), None, self._card()
        if tag == "meta":
            for key in ("property", "name", "itemprop"):
                if key in a and "content" in a:
                    self.metas.setdefault((key, a[key]), a["content"])
        elif tag == "time" and "datetime" in a:
            self.times.append(a["datetime"])
            if card is not None:
                card.setdefault("datetime", a["datetime"])
        elif tag == "a":
            sink = {"href": a.get("href"), "parts": []}
            self.links.append(sink)
        elif tag == "h1":
            sink = {"parts": []}
            self.headings.append(sink)
        elif tag == "script" and a.get("type") == "application/ld+json":
            sink = {"parts": []}
            self.scripts.append(sink)
        if tag == "div" and "data-post" in a:
            sink = {"post": a["data-post"], "files": [], "parts": [], "card": True}
            self.cards.append(sink)
        elif card is not None:
            if CARD_DATE in classes and "href" in a:
                card.setdefault("url", a["href"])
            elif CARD_TEXT in classes and "body" not in card:
                sink = card["body"] = {"parts": [], "begin": self._place()}
            elif CARD_FILE in classes:
                card["files"].append({"name": {"parts": []}, "extra": {"parts": []}})
            elif card["files"] and CARD_FILE_NAME in classes:
                sink = card["files"][-1]["name"]
            elif card["files"] and CARD_FILE_EXTRA in classes:
                sink = card["files"][-1]["extra"]
        if tag not in VOID:
            self.stack.append((tag, sink))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                here = self._place()
                for k, (_, sink) in enumerate(self.stack[i:]):
                    if sink and "begin" in sink:  # an element that is left open ends where the one around it does
                        sink["end"] = here if k else self.html.find(">", here) + 1 or len(self.html)
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if not piece:
            return
        for _, sink in self.stack:
            if sink is not None:
                sink["parts"].append(data if self.stack[-1][0] == "script" else piece)
        if not any(tag in BOILERPLATE for tag, _ in self.stack):
            self.text.append(piece)

    def _place(self) -> int:
        line, offset = self.getpos()
        return self.lines[line - 1] + offset

    def source(self, sink: dict) -> str:
        """The HTML of an element whose ``begin`` was noted."""
        return self.html[sink["begin"] : sink.get("end", len(self.html))]

    def _card(self) -> dict | None:
        return next((sink for _, sink in reversed(self.stack) if sink and sink.get("card")), None)

    def title(self) -> str | None:
        """The first h1 with text, else the titles given for sharing."""
        given = [" ".join(h["parts"]) for h in self.headings[:1]]
        given += [self.metas.get(k, "").strip() for k in (("property", "og:title"), ("name", "twitter:title"))]
        return next(filter(None, given), None)

    def dates(self) -> list[str]:
        """Candidates for the publication date, best first."""
        metas = [self.metas.get(k) for k in (("property", "article:published_time"), ("name", "date"), ("itemprop", "datePublished"))]
        return [x for x in [*metas, *self.times[:1]] if x] + self.linked_data_dates()

    def linked_data_dates(self) -> list[str]:
        """datePublished of every node of the page's JSON-LD, nested graphs after the nodes that hold them."""
        out = []
        for script in self.scripts:
            try:
                found = json.loads("".join(script["parts"]))
            except ValueError:
                continue
            todo = list(found) if isinstance(found, list) else [found]
            for node in todo:
                if isinstance(node, dict):
                    graph = node.get("@graph")
                    todo.extend(graph if isinstance(graph, list) else ())
                    if isinstance(node.get("datePublished"), str):
                        out.append(node["datePublished"])
        return out
