"""SAN and PGN movetext."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .board import FILES, INDEX, NAMES, RANKS, Board, Move, move_uci

SAN = re.compile(r"([NBRQK])?([a-h])?([1-8])?[x:-]?([a-h][1-8])(?:=?\(?([NBRQnbrq])\)?)?")
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")
LEXEME = re.compile(r"\{[^}]*\}?|;[^\n]*|\(|\)|\$\d+|1/2-1/2|1-0|0-1|\*|\d+\s*\.+|[^\s{}();]+")


def resolve_san(board: Board, san: str) -> Move | None:
    """The one legal move that san names; None if there is none, or several."""
    text = san.rstrip("+#!?")
    if text.replace("0", "O") in ("O-O", "O-O-O"):
        row = 0 if board.white else 56
        m = (row + 4, row + (6 if len(text) == 3 else 2), "")
        return m if board.at[m[0]] in "Kk" and board.is_legal(m) else None
    found = SAN.fullmatch(text)
    if not found:
        return None
    kind, file, rank, to, promotion = found.groups()
    fits = [
        m
        for m in board.pseudo_moves(kind or "P")
        if m[1] == INDEX[to]
        and m[2] == (promotion or "").lower()
        and (not file or NAMES[m[0]][0] == file)
        and (not rank or NAMES[m[0]][1] == rank)
        and not (kind == "K" and abs(m[0] - m[1]) == 2)
    ]
    if len(fits) > 1 and not kind and not file:  # a pawn without a file moves straight on
        fits = [m for m in fits if m[0] % 8 == m[1] % 8]
    fits = [m for m in fits if board._leaves_king_safe(m)]
    return fits[0] if len(fits) == 1 else None


def write_san(board: Board, m: Move) -> str:
    """SAN of a legal move."""
    kind = board.at[m[0]].upper()
    if kind == "K" and abs(m[0] - m[1]) == 2:
        text = "O-O" if m[1] > m[0] else "O-O-O"
    else:
        mark = "x" if board.is_capture(m) else ""
        to = NAMES[m[1]] + (f"={m[2].upper()}" if m[2] else "")
        if kind == "P":
            text = (FILES[m[0] % 8] + mark if mark else "") + to
        else:
            rivals = [r[0] for r in board.legal_moves() if r[1] == m[1] and r[0] != m[0] and board.at[r[0]] == board.at[m[0]]]
            hint = ""
            if rivals:
                if all(r % 8 != m[0] % 8 for r in rivals):
                    hint = FILES[m[0] % 8]
                elif all(r // 8 != m[0] // 8 for r in rivals):
                    hint = RANKS[m[0] // 8]
                else:
                    hint = NAMES[m[0]]
            text = kind + hint + mark + to
    after = board.copy()
    after.push(m)
    if after.in_check():
        text += "+" if after.has_legal_move() else "#"
    return text


def san_tokens(movetext: str) -> Iterator[str]:
    """Move tokens of the main line, up to the result."""
    depth = 0
    for lexeme in LEXEME.findall(movetext):
        if lexeme[0] in "{;$" or depth and lexeme not in "()":
            continue
        if lexeme == "(":
            depth += 1
        elif lexeme == ")":
            depth = max(0, depth - 1)
        elif lexeme in RESULTS:
            return
        elif not re.fullmatch(r"\d+\s*\.+|\.+|[!?]+", lexeme):
            yield lexeme


def movetext_to_uci(movetext: str | None, fen: str | None = None) -> list[str] | None:
    """UCI moves of the main line up to the first that cannot be played; None if there are none."""
    if not movetext or not movetext.strip():
        return None
    board, out = Board(fen) if fen else Board(), []
    for token in san_tokens(movetext):
        m = resolve_san(board, token)
        if m is None:
            break
        out.append(move_uci(m))
        board.push(m)
    return out or None


HEADER = re.compile(r'^\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]\s*$')


def split_games(text: str) -> Iterator[tuple[dict[str, str], str]]:
    """(headers, movetext) of each game of a PGN file."""
    headers: dict[str, str] = {}
    body: list[str] = []
    for line in text.splitlines():
        found = HEADER.match(line)
        if found:
            if body and any(x.strip() for x in body):
                yield headers, "\n".join(body)
                headers, body = {}, []
            headers[found[1]] = found[2].replace('\\"', '"').replace("\\\\", "\\")
        elif not line.startswith("%"):
            body.append(line)
    if headers or any(x.strip() for x in body):
        yield headers, "\n".join(body)


def export_pgn(moves: list[str], headers: dict[str, str]) -> str:
    """One game as PGN text."""
    board, words = Board(), []
    for k, text in enumerate(moves):
        if board.white:
            words.append(f"{board.full}.")
        m = next(m for m in board.legal_moves() if move_uci(m) == text)
        words.append(write_san(board, m))
        board.push(m)
    tags = "\n".join(f'[{k} "{v}"]' for k, v in headers.items())
    return f"{tags}\n\n{' '.join([*words, headers.get('Result', '*')])}\n"
