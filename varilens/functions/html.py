"""Minimal HTML tree over the standard-library parser, with the few lookups extraction needs.

Tree building follows the lenient rules of a plain (non-HTML5) parser:
an end tag closes the most recent open element with that name (unknown
end tags are ignored), void elements never have children, and unclosed
elements stay open until the document ends.  Text keeps entities decoded.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs or []), [], parent

    # -- queries -------------------------------------------------------
    def text(self) -> str:
        out = []
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def iter(self):
        """Descendant elements in document order."""
        stack = list(reversed([c for c in self.children if not isinstance(c, str)]))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed([c for c in n.children if not isinstance(c, str)]))

    def matches(self, sel) -> bool:
        tag, cls = sel
        if tag is not None and self.tag not in (tag if isinstance(tag, (tuple, list, set)) else (tag,)):
            return False
        if cls is None:
            return True
        have = self.attrs.get("class") or ""
        return have == cls if " " in cls else cls in have.split()

    def find(self, sel):
        for n in self.iter():
            if n.matches(sel):
                return n
        return None

    def find_all(self, sel):
        return [n for n in self.iter() if n.matches(sel)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", [], None)
        self.cur = self.root
        self._raw = None

    def handle_starttag(self, tag, attrs):
        n = Node(tag, attrs, self.cur)
        self.cur.children.append(n)
        if tag not in VOID:
            self.cur = n

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(Node(tag, attrs, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n is not self.root and n.tag != tag:
            n = n.parent
        if n is not None and n is not self.root:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def parse(html: str | None) -> tuple[Node, str | None]:
    """The tree, and what stopped the parser early (then the tree holds what stands before that place)."""
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except Exception as e:  # noqa: BLE001 - the standard-library parser has no one class for bad markup
        return _unlinked(b.root), f"{type(e).__name__}: {e}"
    return _unlinked(b.root), None


def _unlinked(root: Node) -> Node:
    """The tree without links to parents, which only building needs: freed as soon as it is dropped."""
    for n in root.iter():
        n.parent = None
    return root
