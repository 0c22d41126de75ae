"""SuperMinHash signatures of many sets at once.

Element d draws, for the ranks j = 0, 1, ... of its own random permutation of the m slots,
a slot and a value in [j, j + 1); a slot keeps the smallest value it is given. Since each
element visits every slot with a different rank, the slots are negatively correlated and
the estimate varies less than with independent minima. A set stops at rank j as soon as
every slot of it holds a value below j: later draws are larger, so they change nothing.
"""

import numpy as np

from scriptorium.llm.words import U64, mix

_STEP = 0xD1342543DE82EF95
# ranks drawn without a stored permutation; few sets are still open after these
_TRACED = 4
_BLOCK = 1 << 15


def _draw(elements, rank, slots):
    """Slot index in [rank, slots) and fraction in [0, 1) of each element at this rank."""
    with np.errstate(over="ignore"):
        bits = mix(elements + U64((rank + 1) * _STEP & (1 << 64) - 1))
    index = rank + (((bits >> U64(40)) * U64(slots - rank)) >> U64(24)).astype(np.int64)
    return index, (bits & U64((1 << 40) - 1)).astype(np.float64) / float(1 << 40)


def _lower(table, texts, slots, values):
    """``table[text, slot] = min(itself, value)`` for many at once."""
    flat = table.reshape(-1)
    np.minimum.at(flat, texts * table.shape[1] + slots, values)


def signatures(elements, first, slots=128):
    """One row of ``slots`` values per set; an empty set has infinity everywhere."""
    n = len(first) - 1
    table = np.full((n, slots), np.inf)
    text = np.repeat(np.arange(n), np.diff(first))
    drawn = []
    for rank in range(min(_TRACED, slots)):
        index, value = _draw(elements, rank, slots)
        place = index.copy()
        for i in range(rank - 1, -1, -1):
            place = np.where(place == drawn[i], i, place)
        _lower(table, text, place, rank + value)
        going = (table.max(axis=1) >= rank + 1)[text]
        elements, text = elements[going], text[going]
        drawn = [d[going] for d in (*drawn, index)]
    for at in range(0, len(elements), _BLOCK):
        _finish(
            table, elements[at : at + _BLOCK], text[at : at + _BLOCK],
            [d[at : at + _BLOCK] for d in drawn], slots,
        )
    return table


def _finish(table, elements, text, drawn, slots):
    """The remaining ranks, with the permutation of every element in memory."""
    places = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
    rows = np.arange(len(elements))

    def swap(rank, index):
        here = places[rows, rank].copy()
        places[rows, rank] = places[rows, index]
        places[rows, index] = here

    for rank, index in enumerate(drawn):
        swap(rank, index)
    for rank in range(len(drawn), slots):
        index, value = _draw(elements, rank, slots)
        swap(rank, index)
        _lower(table, text, places[rows, rank].astype(np.int64), rank + value)
        going = (table[text].max(axis=1) >= rank + 1) if rank % 8 == 7 else None
        if going is not None and not going.all():
            elements, text, places = elements[going], text[going], places[going]
            rows = np.arange(len(elements))
        if not len(elements):
            return
