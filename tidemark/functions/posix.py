"""Scalar rules of a POSIX namespace and of storage records, as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

READ, WRITE, EXECUTE = 4, 2, 1


def granted(mode: Column, uid: Column, gid: Column, user: Column, group: Column, want: int) -> Column:
    """Access check: user 0 always; else exactly one class of bits counts: owner, or group, or others."""
    bits = F.when(uid == user, F.shiftright(mode, 6)).when(gid == group, F.shiftright(mode, 3)).otherwise(mode)
    return (user == 0) | (bits.bitwiseAND(want) == want)


def deletable(dir_mode: Column, dir_uid: Column, uid: Column, user: Column) -> Column:
    """Sticky directories let only the owner of the entry or of the directory remove it."""
    return (dir_mode.bitwiseAND(0o1000) == 0) | (user == 0) | (user == uid) | (user == dir_uid)


def without_privilege(mode: Column) -> Column:
    """Clear setuid always, setgid only where the group may execute."""
    plain = mode.bitwiseAND(~0o4000)
    return F.when(mode.bitwiseAND(0o10) != 0, plain.bitwiseAND(~0o2000)).otherwise(plain)


def child_gid(dir_mode: Column, dir_gid: Column, caller_gid: Column) -> Column:
    return F.when(dir_mode.bitwiseAND(0o2000) != 0, dir_gid).otherwise(caller_gid)


def valid_name(name: Column) -> Column:
    """1 to 255 bytes, neither . nor .., no slash."""
    return F.octet_length(name).between(1, 255) & ~name.isin(".", "..") & (F.instr(name, "/") == 0)


def valid_target(target: Column) -> Column:
    return F.octet_length(target).between(1, 4096)


def live(expires_at: Column, now: Column | int) -> Column:
    """Strict: a lease that expires now is over."""
    return expires_at > F.lit(now)


def backoff_ms(attempt: Column) -> Column:
    """1000 ms doubled with each attempt, six times at most."""
    return (F.lit(1000) * F.pow(F.lit(2), F.least(attempt, F.lit(6)))).cast("long")


def error_parts(code: Column) -> Column:
    """(class, subsystem, reason) of a 32-bit code laid out as two, two and four hex digits."""
    code = code.cast("long")
    return F.struct(F.shiftright(code, 24).bitwiseAND(0xFF).alias("class"), F.shiftright(code, 16).bitwiseAND(0xFF).alias("subsystem"), code.bitwiseAND(0xFFFF).alias("reason"))


def low_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def class_bits(mode: Column, uid: Column, gid: Column, user: Column, groups: Column) -> Column:
    """The three bits that count for a user of these groups."""
    return F.when(uid == user, F.shiftright(mode, 6)).when(F.array_contains(groups, gid), F.shiftright(mode, 3)).otherwise(mode).bitwiseAND(7)


def may_create(mode: Column, uid: Column, gid: Column, user: Column, groups: Column) -> Column:
    """Creating in a directory needs write and search."""
    return (user == 0) | (class_bits(mode, uid, gid, user, groups).bitwiseAND(3) == 3)


def may_chown(uid: Column, user: Column, to: Column) -> Column:
    return (user == 0) | ((user == uid) & (to == uid))


def may_chgrp(uid: Column, gid: Column, user: Column, groups: Column, to: Column) -> Column:
    """An owner may give a file to its own group or one that they are in."""
    return (user == 0) | ((user == uid) & ((to == gid) | F.array_contains(groups, to)))


def may_chmod(uid: Column, user: Column) -> Column:
    return (user == 0) | (user == uid)


def may_touch(mode: Column, uid: Column, gid: Column, user: Column, groups: Column, now: Column) -> Column:
    """Times of now also for whoever may write; others for the owner alone."""
    return may_chmod(uid, user) | (now & (class_bits(mode, uid, gid, user, groups).bitwiseAND(WRITE) == WRITE))


def may_set_xattr(kind: Column, mode: Column, uid: Column, gid: Column, user: Column, groups: Column) -> Column:
    """Only files and directories have them; in a sticky directory only its owner sets them."""
    sticky = (kind == "dir") & (mode.bitwiseAND(0o1000) != 0) & (user != 0) & (user != uid)
    return kind.isin("file", "dir") & ~sticky & ((user == 0) | (class_bits(mode, uid, gid, user, groups).bitwiseAND(WRITE) == WRITE))


def valid_xattr(name: Column) -> Column:
    """1 to 255 bytes that begin with `user.`."""
    return F.octet_length(name).between(1, 255) & name.startswith("user.")


U64 = Decimal(2**64 - 1)


def overflows(a: Column, b: Column) -> Column:
    """Whether a sum of two unsigned 64-bit numbers, given as decimals, is none."""
    return a + b > F.lit(U64)


def saturating_add(a: Column, b: Column) -> Column:
    return F.least(a + b, F.lit(U64))


def checked_add(a: Column, b: Column) -> Column:
    """The sum, or an error of the query."""
    return F.when(overflows(a, b), F.raise_error(F.lit("sum overflows")).cast("decimal(38,0)")).otherwise(a + b)


def hash_string(text: Column) -> Column:
    """Hex of a string field of a stable hash: its bytes and the terminator 0xff."""
    return F.concat(F.hex(F.encode(text, "UTF-8")), F.lit("FF"))


def hash_long(n: Column) -> Column:
    """Hex of a number field: eight bytes, least first."""
    big = F.lpad(F.hex(n), 16, "0")
    return F.concat(*[F.substring(big, 2 * k - 1, 2) for k in range(8, 0, -1)])


def field_hash(*fields: Column) -> Column:
    """FNV-1a over fields in hex as a decimal; zero becomes 1."""
    h = fnv1a_hex(F.concat(*fields))
    return F.when(h == 0, F.lit(1).cast("decimal(38,0)")).otherwise(h)


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as a decimal."""
    return fnv1a_hex(F.hex(F.encode(text, "UTF-8")))


def fnv1a_hex(data: Column) -> Column:
    """FNV-1a of bytes in hex: 64-bit wrapping arithmetic by 32-bit halves, JVM-side.

    h * p for p = 2**40 + 0x1b3 splits into a shift and two small products, none beyond 2**63."""
    low, high = F.lit(0x84222325).cast("long"), F.lit(0xCBF29CE4).cast("long")
    start = F.struct(low.alias("l"), high.alias("h"))

    def step(acc, i):
        byte = F.conv(F.substring(data, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
        x = acc["l"].bitwiseXOR(byte)
        product = x * 0x1B3
        carried = acc["h"] * 0x1B3 + F.shiftright(product, 32) + F.shiftleft(x.bitwiseAND(0xFFFFFF), 8)
        return F.struct(product.bitwiseAND(0xFFFFFFFF).alias("l"), carried.bitwiseAND(0xFFFFFFFF).alias("h"))

    size = (F.length(data) / 2).cast("int")
    out = F.when(size == 0, start).otherwise(F.aggregate(F.sequence(F.lit(0), size - 1), start, step))
    return out["h"].cast("decimal(20,0)") * F.lit(2**32).cast("decimal(11,0)") + out["l"].cast("decimal(20,0)")
