"""A document read in pieces of any size: each block leaves as soon as it closes.

What is held is the header, the open block's tokens and the names of the open elements; no
tree of the document is made.  The rows are those of a whole parse for every good document.
Of one that turns out bad, the blocks before the fault have left already; then comes its error,
and nothing after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa

from . import errors
from .parse import _SPACES, Rejected, _header, _Node, _token, block_of, ill_formed, is_hi, is_pause

#: Bytes given to the parser at once.
PIECE = 1 << 20
#: Tokens, and characters of theirs, that a batch of blocks has at least before it is sent.
SENT_TOKENS, SENT_CHARS = 5_000, 1_000_000


class PullParser:
    """``feed`` bytes, then ``close``; ``blocks`` fills up with what has closed meanwhile, and
    ``error`` is set once there is one.  The caller empties ``blocks``."""

    def __init__(self):
        self.blocks: list[dict] = []
        self.error: str | None = None
        self._path: list[str] = []
        self._seen: set[str] = set()
        self._header: list[_Node] = []  # open elements of the header
        self._chars: list[str] = []
        self._block: tuple | None = None
        self._tokens: list[dict] = []
        self._open: list[tuple[str, int]] = []  # open inline elements, and the tokens before their content
        own = self._parser = expat.ParserCreate("utf-8")
        own.buffer_text = True
        own.StartElementHandler, own.EndElementHandler, own.CharacterDataHandler = self._start, self._end, self._chars.append

    def feed(self, data: bytes, last: bool = False) -> None:
        if self.error is None:
            try:
                self._parser.Parse(data, last)
                if last:
                    self._end_of_document()
            except Rejected as e:
                self.error = errors.XML + str(e)
            except expat.ExpatError as e:
                self.error = errors.XML + str(ill_formed(e))

    def close(self) -> None:
        self.feed(b"", True)

    def _end_of_document(self) -> None:
        for name in ("teiHeader", "text", "body"):
            if name not in self._seen:
                raise Rejected(f"missing field `{name}`")

    def _once(self, name: str) -> None:
        if name in self._seen:
            raise Rejected(f"duplicate field `{name}`")
        self._seen.add(name)

    def _start(self, name: str, attributes: dict) -> None:
        self._text()
        path = self._path
        if self._header:
            node = _Node(name, attributes)
            self._header[-1].children.append(node)
            self._header.append(node)
        elif self._block:
            if self._open and self._open[-1][0] == "pause":
                raise Rejected(errors.INLINE)
            if not (is_pause(name, attributes) or is_hi(name, attributes)):
                raise Rejected(errors.INLINE)
            self._tokens.append(_token(len(self._open), name, **attributes))
            self._open.append((name, len(self._tokens)))
        elif not path:
            if name != "TEI":
                raise Rejected("missing field `teiHeader`")
        elif path == ["TEI"] and name == "teiHeader":
            self._once(name)
            self._header.append(_Node(name, attributes))
        elif path == ["TEI"] and name == "text" or path == ["TEI", "text"] and name == "body":
            self._once(name)
        elif path == ["TEI", "text", "body"]:
            if name not in ("p", "u"):
                raise Rejected(f"unknown variant `{name}`, expected `p` or `u`")
            self._block = (name, attributes.get("xml:id", attributes.get("id")), attributes.get("who") if name == "u" else None)
        path.append(name)

    def _end(self, name: str) -> None:
        self._text()
        self._path.pop()
        if self._header:
            node = self._header.pop()
            if not self._header:
                _header(node)
        elif self._open:
            kind, before = self._open.pop()
            if kind == "hi" and len(self._tokens) == before:
                raise Rejected(errors.INLINE)
        elif self._block:
            self.blocks.append(block_of(*self._block, self._tokens))
            self._block, self._tokens = None, []

    def _text(self) -> None:
        if not self._chars:
            return
        text = "".join(self._chars)
        self._chars.clear()
        if self._header:
            self._header[-1].children.append(text)
        elif not text.strip(_SPACES):
            return
        elif self._block:
            if self._open and self._open[-1][0] == "pause":
                raise Rejected(errors.INLINE)
            self._tokens.append(_token(len(self._open), "text", text=text))
        elif self._path == ["TEI", "text", "body"]:
            raise Rejected("unknown variant `$text`, expected `p` or `u`")


def pieces_of(text: str | None) -> Iterator[bytes]:
    """A text's bytes, without a copy of them all."""
    for at in range(0, len(text or ""), PIECE):
        yield text[at : at + PIECE].encode("utf-8", "surrogatepass")


class Sender:
    """Rows of blocks as batches of bounded size.  ``fields``: the types of the columns after
    the key and the block's place."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.tokens, self.chars = schema, [], 0, 0

    def add(self, key, place: int | None, block: dict | None, error: str | None) -> None:
        own = block or dict.fromkeys(("kind", "id", "who", "inline"))
        self.rows.append({"doc_key": key, "block_pos": place, **own, "error": error and error.encode("utf-8", "replace").decode()})
        self.tokens += 1 + len(own["inline"] or ())
        self.chars += sum(len(t["text"] or "") for t in own["inline"] or ())

    def take(self, least: bool = True) -> Iterator[pa.RecordBatch]:
        """A batch if there is enough for one, or at the end what there is."""
        if self.rows and (not least or self.tokens >= SENT_TOKENS or self.chars >= SENT_CHARS):
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
            self.rows, self.tokens, self.chars = [], 0, 0


class Document:
    """One document's rows: numbers its blocks and hands them to a sender."""

    def __init__(self, key, sender: Sender):
        self.key, self.sender, self.parser, self.place = key, sender, PullParser(), 0

    def feed(self, data: bytes, last: bool = False) -> Iterator[pa.RecordBatch]:
        failed = self.parser.error is not None
        self.parser.feed(data, last)
        for block in self.parser.blocks:
            self.sender.add(self.key, self.place, block, None)
            self.place += 1
            yield from self.sender.take()
        self.parser.blocks.clear()
        if self.parser.error is not None and not failed:
            self.sender.add(self.key, None, None, self.parser.error)
