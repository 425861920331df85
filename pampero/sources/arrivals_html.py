"""Arrivals pages: markup to rows.

A small tag scanner that follows ``div``, ``table``, ``tr`` and ``td`` nesting; it never repairs
markup, so a row counts only if its own closing tag is there.
"""

from __future__ import annotations

import html as _html
import re
from itertools import product
from urllib.parse import unquote

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TRANSFER = re.compile(r"transfer_id/(\d+)")
_SPACE = re.compile(r"\s+")
_ANY = re.compile(r"<[^>]*>")

#: A whole row in the source's own layout: nothing in it that needs resolving (``&``, ``%``), no tag or quote more than these.
_T = r"[^<>&]*"
_Q = r"""(?:"[^"'<>&%=]*"|'[^"'<>&%=]*')"""
_C = rf"(?: +class={_Q})?"
_IMG = rf"""(?:<img class=(?:"flaggenrahmen"|'flaggenrahmen') title=({_Q})>)?"""
_USUAL = re.compile(
    rf"""<tr{_C}>\s*<td>{_T}</td>\s*"""
    rf"""<td>\s*<table{_C}><tr><td{_C}><a title=({_Q}) href=({_Q})>{_T}</a></td></tr>\s*<tr><td>({_T})</td></tr></table></td>\s*"""
    rf"""<td>({_T})</td>\s*<td>{_IMG}{_IMG}</td>\s*"""
    rf"""<td><table><tr><td{_C}><a title=({_Q}) href=({_Q})>{_T}</a></td></tr></table></td>\s*"""
    rf"""<td><a href=({_Q})>({_T})</a></td>\s*</tr>"""
)
_PLAYER, _CLUB = re.compile(r"/profil/spieler/([A-Za-z0-9]+)"), re.compile(r"/verein/([A-Za-z0-9]+)")

#: The tags that the scanner follows, in any case.
_NAMES = {"".join(x): n for n in ("div", "h2", "table", "tr", "td", "th", "a") for x in product(*((c, c.upper()) for c in n))}

FIELDS = ["jugador_nombre", "jugador_tm_id", "posicion_tm", "edad_al_fichaje", "nacionalidad", "nacionalidad_2", "club_origen", "club_origen_id", "club_origen_slug", "club_origen_pais", "club_origen_liga", "club_origen_liga_id", "coste_fichaje_texto", "operacion_id"]


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag, entities and percent signs resolved."""
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text else {}


def _plain(markup: str) -> str:
    return _SPACE.sub(" ", _html.unescape(_ANY.sub(" ", markup))).strip()


def _id_after(word: str, href: str) -> str | None:
    m = re.search(rf"/{word}/([A-Za-z0-9]+)", href)
    return m[1] if m else None


class _Link(dict):
    """A link's attributes; its text is read off the markup only where it is asked for."""

    def __init__(self, attrs: dict, markup: str, at: int):
        super().__init__(attrs)
        self.markup, self.at = markup, at

    def text(self) -> str | None:
        end = self.markup.find("</", self.at)
        return _plain(self.markup[self.at : end if end >= 0 else len(self.markup)]) or None


def _links(markup: str) -> list[_Link]:
    return [_Link(attributes(m[3]), markup, m.end()) for m in _TAG.finditer(markup) if m[2] in "aA" and not m[1]] if "<a" in markup or "<A" in markup else []


def _flags(markup: str) -> list[str]:
    if "flaggenrahmen" not in markup:
        return []
    return [a["title"] for m in _TAG.finditer(markup) if m[2].lower() == "img" and "flaggenrahmen" in (a := attributes(m[3])).get("class", "") and a.get("title")]


def _row(cells: list[str], operation: str) -> tuple:
    """The fields of one arrival from its direct cells; what a row lacks is null."""
    out = dict.fromkeys(FIELDS)
    out["operacion_id"] = operation
    links = [link for c in cells for link in _links(c)]
    player = next((x for x in links if "/profil/spieler/" in x.get("href", "")), None)
    if player:
        out["jugador_tm_id"] = _id_after("spieler", player["href"])
        out["jugador_nombre"] = player.get("title") or player.text()
    if len(cells) >= 5:
        own = next((i for i, c in enumerate(cells) if "/profil/spieler/" in c), 1)
        inner = re.split(r"(?i)<tr\b[^>]*>", cells[own])
        if len(inner) > 2:
            out["posicion_tm"] = _plain(inner[2]) or None
        age = re.sub(r"\D", "", _plain(cells[own + 1])) if own + 1 < len(cells) else ""
        out["edad_al_fichaje"] = int(age) if age and len(age) < 4 else None
        flags = [f for c in cells[own + 1 : -2] for f in _flags(c)]
        out["nacionalidad"], out["nacionalidad_2"] = (flags + [None, None])[:2]
        clubs = _links(cells[-2])
        club = next((x for x in clubs if "/verein/" in x.get("href", "")), None)
        league = next((x for x in clubs if "/wettbewerb/" in x.get("href", "")), None)
        if club:
            out["club_origen"], out["club_origen_id"] = club.get("title") or club.text(), _id_after("verein", club["href"])
            parts = club["href"].split("/")
            out["club_origen_slug"] = parts[1] if len(parts) > 2 and parts[1] else None
        if league:
            out["club_origen_liga"], out["club_origen_liga_id"] = league.get("title") or league.text(), _id_after("wettbewerb", league["href"])
        out["club_origen_pais"] = next(iter(_flags(cells[-2])), None)
        out["coste_fichaje_texto"] = _plain(cells[-1]) or None
    return tuple(out[f] for f in FIELDS)


def _usual(m: re.Match) -> tuple | None:
    """The fields of a row that ``_USUAL`` matched, as ``_row`` gives them; None where the row has to be read by its tags."""
    player, player_at, position, age, flag, flag_2, club, club_at, at, fee = m.groups()
    operation, who, where = _TRANSFER.search(at), _PLAYER.search(player_at), _CLUB.search(club_at)
    first = m[0][: m.start(2) - m.start()]  # up to the player's link
    if not (operation and who and where) or len(player) < 3 or len(club) < 3 or "transfer_id" in player_at + club_at or "/wettbewerb/" in club_at:
        return None
    if "/profil/spieler/" in first or player_at.find("/spieler/") != who.start() + len("/profil"):
        return None
    digits = re.sub(r"\D", "", age)
    flags = [f[1:-1] for f in (flag, flag_2) if f and len(f) > 2]
    parts = club_at[1:-1].split("/")
    return (
        player[1:-1], who[1], " ".join(position.split()) or None, int(digits) if digits and len(digits) < 4 else None, *(flags + [None, None])[:2],
        club[1:-1], where[1], parts[1] if len(parts) > 2 and parts[1] else None, None, None, None, " ".join(fee.split()) or None, operation[1],
    )


def arrivals(page: str | None) -> list[tuple]:
    """The closed rows with a transfer link in the Arrivals boxes of a page, in order; see ``FIELDS``.

    A box is a ``div`` of class ``box`` whose ``h2`` holds "arrival" in any case. Comments, other
    boxes and rows without their own ``</tr>`` give nothing; a null, blank or broken page gives [].
    """
    if not page or "transfer" not in page:
        return []
    page = _COMMENT.sub("", page)
    found: list[tuple] = []
    divs: list[list] = []  # [is a box, holds arrivals]
    rows: list[list] = []  # [table depth, start of the row, operation, cells, start of the open cell]
    depth, heading, at = 0, None, 0
    while m := _TAG.search(page, at):
        at = m.end()
        closing, name = m[1] == "/", _NAMES.get(m[2])
        if name is None:
            continue
        if name == "div":
            if closing:
                if divs:
                    divs.pop()
                    rows.clear()
            else:
                divs.append([("box" in m[3] or "&" in m[3]) and "box" in attributes(m[3]).get("class", "").split(), False])
        elif name == "h2":
            if not closing:
                heading = m.end()
            elif heading is not None and divs:
                box = next((d for d in reversed(divs) if d[0]), None)
                if box:
                    box[1] = "arrival" in _plain(page[heading : m.start()]).casefold()
                heading = None
        elif name == "table":
            if closing:
                while rows and rows[-1][0] >= depth:
                    rows.pop()
                depth = max(0, depth - 1)
            else:
                depth += 1
        elif name == "tr":
            if not closing:
                while rows and rows[-1][0] >= depth:
                    rows.pop()
                if not rows and (whole := _USUAL.match(page, m.start())) and (row := _usual(whole)):
                    if any(d[1] for d in divs):
                        found.append(row)
                    at = whole.end()
                    continue
                rows.append([depth, m.end(), None, [], None])
            elif rows and rows[-1][0] == depth:
                row = rows.pop()
                if not rows and row[2] and any(d[1] for d in divs):
                    found.append(_row(row[3], row[2]))
        elif name in ("td", "th"):
            if rows and rows[-1][0] == depth:
                row = rows[-1]
                if not closing:
                    row[4] = m.end()
                elif row[4] is not None:
                    row[3].append(page[row[4] : m.start()])
                    row[4] = None
        elif name == "a" and not closing and rows and ("transfer_id" in m[3] or "&" in m[3] or "%" in m[3]):
            hit = _TRANSFER.search(unquote(attributes(m[3]).get("href", "")))
            if hit:
                for row in rows:
                    row[2] = row[2] or hit[1]
    return found
