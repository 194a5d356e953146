"""A forgiving base for readers of HTML."""

from __future__ import annotations

from html.parser import HTMLParser


class LenientParser(HTMLParser):
    """Reads unknown marked sections (``<![foo[bar]]>``) as a browser does, as a comment up to the next ``>``."""

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)
