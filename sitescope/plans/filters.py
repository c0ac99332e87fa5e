"""A filter of hashed keys that every task can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for a key, and at most; bits that a key sets.
BITS, MOST, PROBES = 32, 1 << 27, 3
LOW = (1 << 32) - 1


class KeyFilter:
    """Bits that hashed keys (longs) set, each three of them: no key of the table is left out, and of others one in a thousand passes.

    The bits are set in Spark and merged by words of 64; the driver gets those words, 16 MB of bits at most. A table of more keys
    than MOST bits serve fills them more, so that more of the others pass: what passes is still to be joined with the table.
    """

    def __init__(self, keys: DataFrame, key: str) -> None:
        import numpy as np

        size = min(max(1 << (BITS * keys.count()).bit_length(), 1 << 16), MOST)
        step = F.shiftrightunsigned(key, 32).bitwiseOR(F.lit(1))
        bits = [(F.col(key).bitwiseAND(F.lit(LOW)) + step * i).bitwiseAND(F.lit(size - 1)) for i in range(PROBES)]
        words = keys.select(F.explode(F.array(*bits)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
        found = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toArrow()
        own = np.zeros(size // 64, np.int64)
        own[found["word"].to_numpy()] = found["bits"].to_numpy()
        self.size, self.shared = size, keys.sparkSession.sparkContext.broadcast(own)

    def may_hold(self, hashes):
        """Places of hashes (a column of uint64) whose bits are all set."""
        import numpy as np

        at, own = np.arange(len(hashes)), self.shared.value
        for i in range(PROBES):
            h = hashes[at]
            bit = (((h & np.uint64(LOW)) + ((h >> np.uint64(32)) | np.uint64(1)) * np.uint64(i)) & np.uint64(self.size - 1)).view(np.int64)
            at = at[(own[bit >> 6] >> (bit & 63)) & 1 == 1]
        return at
