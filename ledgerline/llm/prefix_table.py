"""Exact BPE by a table over prefixes, as SentencePiece's merges define it.

For every prefix of a pre-token exactly one vocabulary piece ends its encoding. An automaton gives the pieces
that end at a place; the one is right whose predecessor (the last piece of the shorter prefix) may stand before
it, that is, merging the two pieces' characters gives back just these two. Ids are read backwards from the
table. A character outside the vocabulary takes part in no merge and becomes its UTF-8 bytes.

Work is linear in the text's length: a place has at most as many candidates as the longest piece has characters.
"""

import ahocorasick
import sentencepiece

from ledgerline.llm.pieces import check, normal_form


def merge(text: str, score: dict[str, float], last: list[str] | None = None) -> list[str]:
    """The definition: join the neighbours with the best joint score, the leftmost first, until none is left.

    `last` gets the two parts of the last join.
    """
    parts = list(text)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            return parts
        if last is not None:
            last[:] = parts[at : at + 2]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class PrefixTable:
    """Encoder of pre-tokens. `memo_entries` bounds the remembered compatibility tests."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, memo_entries: int = 250_000) -> None:
        check(model)
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                self.byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[model.id_to_piece(i)] = i
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.pieces = {i: p for p, i in self.ids.items()}
        self.known = {p for p in self.ids if len(p) == 1}
        self.start = model.get_piece_size()
        self.size = self.start + 1
        self.length = [len(self.pieces.get(i, " ")) for i in range(self.size)]
        order = {s: i for i, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in self.score.items()}
        self.joins: dict[str, tuple[str, str] | None] = {}
        self.memo: dict[int, bool] = {}
        self.memo_entries = memo_entries

    def _last_join(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that `piece` is joined from in the end; None for one character or an unreachable piece."""
        if piece not in self.joins:
            parts: list[str] = list(piece)
            self.joins[piece] = None
            if len(parts) > 1 and merge(piece, self.score, parts) == [piece]:
                self.joins[piece] = (parts[0], parts[1])
        return self.joins[piece]

    def _reachable(self, piece: str) -> bool:
        return len(piece) == 1 or self._last_join(piece) is not None

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether no join across the border comes before the joins that make `left` and `right`.

        Undoes the later of the two pieces' last joins again and again. What then meets at the border must not
        be joinable earlier than the join that was undone last; of equal joins the left one comes first.
        """
        rank = self.rank
        best, ties = None, False  # a join across of a better rank than `best`, or the same if `ties`, comes first
        while True:
            across = rank.get(left + right)
            if across is not None and (best is None or across < best or ties and across == best):
                return False
            a, b = self._last_join(left), self._last_join(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and rank[left] > rank[right]:
                best, ties, left = rank[left], False, a[1]
            else:
                best, ties, right = rank[right], True, b[0]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether piece `right` may follow piece `left`; `start` only asks for `right` itself."""
        pieces = self.pieces
        ok = self._reachable(pieces[right]) and (left == self.start or self._stay_apart(pieces[left], pieces[right]))
        if len(self.memo) >= self.memo_entries:
            self.memo.clear()
        self.memo[left * self.size + right] = ok
        return ok

    def encode(self, text: str) -> list[int]:
        """Ids of one pre-token in normal form."""
        ids, memo, length, size, start = self.ids, self.memo, self.length, self.size, self.start
        last = [start, *[-1] * len(text)]  # ids of last pieces, by prefix length; `start` also after unknown characters
        if not self.known.issuperset(text):
            for i, c in enumerate(text, 1):
                if c not in ids:
                    last[i] = start
        for end, piece in self.automaton.iter(text):
            end += 1
            if last[end] < 0 and (left := last[end - length[piece]]) >= 0:
                ok = memo.get(left * size + piece)
                if self._compatible(left, piece) if ok is None else ok:
                    last[end] = piece
        out: list[int] = []
        at = len(text)
        while at:
            piece = last[at]
            if piece == start:
                out.extend(self.byte_ids[b] for b in reversed(text[at - 1].encode()))
                at -= 1
            else:
                out.append(piece)
                at -= length[piece]
        out.reverse()
        return out

    def encode_key(self, key: str) -> list[int]:
        return self.encode(normal_form(key))
