"""Interactive modules as payload: custom and chess packs, and puzzles made from a level, for whatever player shows them."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import explode_rows
from .packs import MODULE_VERSION, STUDY_VERSION, normalize_game, pack_json

#: Clues of a difficulty at level 1 and at least; colours, balls of a tube, empty tubes and tries of a level.
CLUES, LEAST_CLUES = {"easy": 40, "medium": 32, "hard": 26}, 22
BASE_COLOURS, MOST_COLOURS, TUBE, EMPTY, TRIES = 4, 12, 4, 2, 20

# For each cell the cells that it must differ from.
PEERS = [[j for j in range(81) if j != i and (j // 9 == i // 9 or j % 9 == i % 9 or (j // 27 == i // 27 and j % 9 // 3 == i % 9 // 3))] for i in range(81)]


def custom_document(title: str, module: dict, kind: str = "custom", module_id: str = "", config: dict | None = None, markdown: str | None = None, source: str | None = None, created_at: str | None = None) -> dict:
    """A study document that holds one module and no blocks. A module needs html, css, js or documentHtml."""
    if not any(module.get(k) for k in ("html", "css", "js", "documentHtml")):
        raise ValueError("a module needs html, css, js or documentHtml")
    game = {"kind": kind, "id": module_id or f"{kind}-1", "title": title, "config": config or {}, "module": {"version": MODULE_VERSION, **module}}
    counts = dict.fromkeys(("blockCount", "chunkCount", "embeddedChunkCount", "flashCardCount", "mcqCount"), 0) | {"gameCount": 1}
    return {"version": STUDY_VERSION, "title": title, "source": source, "createdAt": created_at, "markdown": markdown or f"# {title}\n", "blocks": [], "chunks": [], "flashCards": [], "mcqs": [], "games": [normalize_game(game, "")], "models": None, "stats": counts, "warnings": []}


def chess_document(title: str, module: dict, fen: str | None = None, pgn: str | None = None, player_color: str = "w", difficulty: int = 3, mode: str = "play") -> dict:
    """A chess module with its settings; the player's page is the caller's."""
    said = {"fen": fen, "pgn": pgn, "playerColor": player_color, "difficulty": difficulty, "mode": mode}
    return custom_document(title, module, "chess", "chess-1", {k: v for k, v in said.items() if v is not None})


def pack_documents(docs: DataFrame) -> DataFrame:
    """doc_id and pack of doc_id and document (JSON)."""
    return docs.select("doc_id", pack_json(F.col("document")).alias("pack"))


def _options(board: list[int], cell: int) -> list[int]:
    taken = {board[j] for j in PEERS[cell]}
    return [n for n in range(1, 10) if n not in taken]


def _tightest(board: list[int]) -> tuple[int, list[int]] | None:
    """The empty cell with the fewest digits left, and these; None for a full board."""
    best = None
    for i in range(81):
        if not board[i]:
            left = _options(board, i)
            if best is None or len(left) < len(best[1]):
                best = (i, left)
            if len(left) < 2:
                break
    return best


def solutions(board: list[int], most: int = 2, rand: random.Random | None = None) -> list[list[int]]:
    """Up to so many solutions of a board (81 digits, 0 for empty)."""
    board, found = board[:], []

    def fill() -> None:
        at = _tightest(board)
        if at is None:
            found.append(board[:])
            return
        cell, left = at
        for n in rand.sample(left, len(left)) if rand else left:
            board[cell] = n
            fill()
            if len(found) >= most:
                return
        board[cell] = 0

    fill()
    return found


def clues_for(level: int, difficulty: str) -> int:
    return max(LEAST_CLUES, CLUES.get(difficulty, CLUES["easy"]) - 2 * ((level - 1) // 2))


def sudoku(level: int, difficulty: str = "easy") -> tuple[str, str]:
    """A puzzle with one solution, and it, as 81 digits; the same for a level and difficulty. Cells go while one solution is left."""
    rand = random.Random(f"sudoku/{level}/{difficulty}")
    full = solutions([0] * 81, 1, rand)[0]
    board, clues = full[:], 81
    for cell in rand.sample(range(81), 81):
        if clues <= clues_for(level, difficulty):
            break
        board[cell] = 0
        if len(solutions(board)) == 1:
            clues -= 1
        else:
            board[cell] = full[cell]
    return "".join(map(str, board)), "".join(map(str, full))


def colours_for(level: int) -> int:
    return min(MOST_COLOURS, BASE_COLOURS + (level - 1) // 2)


def ball_sort(level: int) -> list[list[int]]:
    """Tubes of coloured balls for a level, shuffled until not sorted already, and empty tubes."""
    rand, n = random.Random(f"balls/{level}"), colours_for(level)
    balls = [c for c in range(n) for _ in range(TUBE)]
    for _ in range(TRIES):
        rand.shuffle(balls)
        tubes = [balls[i : i + TUBE] for i in range(0, len(balls), TUBE)]
        if any(len(set(t)) > 1 for t in tubes):
            break
    return [*tubes, *([] for _ in range(EMPTY))]


def sudoku_puzzles(levels: DataFrame) -> DataFrame:
    """levels (level, difficulty) with puzzle, solution and clues."""

    def made(level: int, difficulty: str) -> Iterator[tuple[str, str, int]]:
        puzzle, solution = sudoku(level or 1, difficulty or "easy")
        yield puzzle, solution, 81 - puzzle.count("0")

    both = levels.select("*", F.col("level").alias("__l"), F.col("difficulty").alias("__d"))
    return explode_rows(both, ["__l", "__d"], made, "puzzle string, solution string, clues int")


def ball_sort_puzzles(levels: DataFrame) -> DataFrame:
    """levels (level) with tubes as JSON."""
    return explode_rows(levels.select("*", F.col("level").alias("__l")), ["__l"], lambda level: [(json.dumps(ball_sort(level or 1)),)], "tubes string")
