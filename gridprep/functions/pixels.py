"""Colours of single pixels."""

from pyspark.sql import functions as F

from gridprep.constants import BLANK, BLANK_ABOVE, BLANK_BELOW, PALETTE_START


def over_white(channel, alpha, kind="double"):
    """One channel laid over white, cut to a whole number.

    `kind="float"` computes in single precision, as the exact-size loader does.
    """
    share = (alpha / F.lit(255).cast("double")).cast(kind)
    white = F.lit(255).cast(kind)
    one = F.lit(1).cast(kind)
    return F.floor(channel.cast(kind) * share + white * (one - share)).cast("int")


def palette_token(r, g, b):
    """The palette character of a colour; near-white and near-black are blank."""
    code = (
        F.shiftright(r, 6) * 16 + F.shiftright(g, 6) * 4 + F.shiftright(b, 6) + PALETTE_START
    )
    is_blank = (F.least(r, g, b) > BLANK_ABOVE) | (F.greatest(r, g, b) < BLANK_BELOW)
    return F.when(is_blank, F.lit(BLANK)).otherwise(F.chr(code))


def palette_level(token, channel):
    """The centre of a token's colour bin in channel "r", "g" or "b"; a missing token is black."""
    bits = {"r": 4, "g": 2, "b": 0}[channel]
    level = F.shiftright(F.ascii(token) - PALETTE_START, bits)
    if channel != "r":
        level = F.pmod(level, F.lit(4))
    return (
        F.when(token.isNull(), F.lit(0))
        .when(token == BLANK, F.lit(255))
        .otherwise(level * 64 + 32)
        .cast("int")
    )
