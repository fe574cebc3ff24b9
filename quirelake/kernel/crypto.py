"""Ciphers and the standard security handler, revisions 2 to 6."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from .objects import Name, PdfError, Ref, Str, Stream

#: Padding of passwords, fixed by the file format.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def keystream(key: bytes, n: int) -> bytes:
    """The n bytes that RC4 adds to data."""
    s, j = list(range(256)), 0
    for i, k in enumerate((key * (256 // len(key) + 1))[:256]):
        a = s[i]
        j = (j + a + k) & 255
        s[i] = s[j]
        s[j] = a
    out, i, j = bytearray(n), 0, 0
    for k in range(n):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        b = s[j]
        s[i] = b
        s[j] = a
        out[k] = s[(a + b) & 255]
    return bytes(out)


def added(a: bytes, b: bytes) -> bytes:
    """Bytes of the same number, added bit by bit."""
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(len(a), "big")


def rc4(key: bytes, data: bytes) -> bytes:
    return added(data, keystream(key, len(data)))


@lru_cache(maxsize=64)
def _layers(key: bytes, n: int) -> bytes:
    """What 20 rounds of RC4 add to n bytes, each with the key changed by its number; in whatever order, they add the same."""
    out = bytes(n)
    for i in range(20):
        out = added(out, keystream(bytes(b ^ i for b in key), n))
    return out


def _double(x: int) -> int:
    return (x << 1 ^ (0x11B if x & 128 else 0)) & 255


def _tables() -> tuple[bytes, bytes, list[list[int]], list[list[int]]]:
    """Substitution box, its inverse, and the round tables for both directions, from the field's arithmetic."""
    log, power, x = [0] * 256, [0] * 255, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= _double(x)
    mul = lambda a, b: power[(log[a] + log[b]) % 255] if a and b else 0
    box = bytearray(256)
    for a in range(256):
        inverse = power[-log[a] % 255] if a else 0
        y = inverse
        for _ in range(4):
            inverse = (inverse << 1 | inverse >> 7) & 255
            y ^= inverse
        box[a] = y ^ 0x63
    back = bytearray(256)
    for a, b in enumerate(box):
        back[b] = a
    word = lambda b, m: mul(b, m[0]) << 24 | mul(b, m[1]) << 16 | mul(b, m[2]) << 8 | mul(b, m[3])
    turn = lambda w, n: (w >> 8 * n | w << 32 - 8 * n) & 0xFFFFFFFF if n else w
    forth = [[turn(word(box[b], (2, 1, 1, 3)), n) for b in range(256)] for n in range(4)]
    undo = [[turn(word(b, (14, 9, 13, 11)), n) for b in range(256)] for n in range(4)]
    return bytes(box), bytes(back), forth, undo


BOX, BACK, FORTH, UNDO = _tables()
_BACK, _UNDO = np.frombuffer(BACK, np.uint8).astype(np.uint32), [np.array(t, np.uint32) for t in UNDO]
#: Bytes from which blocks are decrypted together.
AT_ONCE = 512


class Aes:
    def __init__(self, key: bytes):
        n = len(key) // 4
        words = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(n)]
        self.rounds, rcon = n + 6, 1
        sub = lambda w: BOX[w >> 24] << 24 | BOX[w >> 16 & 255] << 16 | BOX[w >> 8 & 255] << 8 | BOX[w & 255]
        for i in range(n, 4 * (self.rounds + 1)):
            w = words[-1]
            if i % n == 0:
                w = sub((w << 8 | w >> 24) & 0xFFFFFFFF) ^ rcon << 24
                rcon = _double(rcon)
            elif n > 6 and i % n == 4:
                w = sub(w)
            words.append(words[i - n] ^ w)
        self.keys = words
        self.back_keys = [w if i < 4 or i >= 4 * self.rounds else UNDO[0][w >> 24] ^ UNDO[1][w >> 16 & 255] ^ UNDO[2][w >> 8 & 255] ^ UNDO[3][w & 255] for i, w in enumerate(words)]

    def block(self, data: bytes) -> bytes:
        return self._block(int.from_bytes(data, "big")).to_bytes(16, "big")

    def _block(self, x: int) -> int:
        k, (f0, f1, f2, f3) = self.keys, FORTH
        a, b, c, d = x >> 96 ^ k[0], (x >> 64 & 0xFFFFFFFF) ^ k[1], (x >> 32 & 0xFFFFFFFF) ^ k[2], (x & 0xFFFFFFFF) ^ k[3]
        for r in range(4, 4 * self.rounds, 4):
            a, b, c, d = (
                f0[a >> 24] ^ f1[b >> 16 & 255] ^ f2[c >> 8 & 255] ^ f3[d & 255] ^ k[r], f0[b >> 24] ^ f1[c >> 16 & 255] ^ f2[d >> 8 & 255] ^ f3[a & 255] ^ k[r + 1],
                f0[c >> 24] ^ f1[d >> 16 & 255] ^ f2[a >> 8 & 255] ^ f3[b & 255] ^ k[r + 2], f0[d >> 24] ^ f1[a >> 16 & 255] ^ f2[b >> 8 & 255] ^ f3[c & 255] ^ k[r + 3],
            )
        s, r = BOX, 4 * self.rounds
        return (
            ((s[a >> 24] << 24 | s[b >> 16 & 255] << 16 | s[c >> 8 & 255] << 8 | s[d & 255]) ^ k[r]) << 96 | ((s[b >> 24] << 24 | s[c >> 16 & 255] << 16 | s[d >> 8 & 255] << 8 | s[a & 255]) ^ k[r + 1]) << 64
            | ((s[c >> 24] << 24 | s[d >> 16 & 255] << 16 | s[a >> 8 & 255] << 8 | s[b & 255]) ^ k[r + 2]) << 32 | ((s[d >> 24] << 24 | s[a >> 16 & 255] << 16 | s[b >> 8 & 255] << 8 | s[c & 255]) ^ k[r + 3])
        )

    def unblocks(self, data: bytes) -> bytes:
        """Whole blocks, each decrypted for itself: all go through a round at once."""
        s = np.frombuffer(data, ">u4").reshape(-1, 4).T.astype(np.uint32) ^ np.array(self.keys[4 * self.rounds :], np.uint32)[:, None]
        keys = np.array(self.back_keys, np.uint32)[:, None]
        for r in range(self.rounds - 1, -1, -1):
            t = [(_BACK[s[i] >> 24] << 24) | (_BACK[s[i - 1] >> 16 & 255] << 16) | (_BACK[s[i - 2] >> 8 & 255] << 8) | _BACK[s[i - 3] & 255] for i in range(4)]
            if r:
                t = [_UNDO[0][w >> 24] ^ _UNDO[1][w >> 16 & 255] ^ _UNDO[2][w >> 8 & 255] ^ _UNDO[3][w & 255] for w in t]
            s = np.stack(t) ^ keys[4 * r : 4 * r + 4]
        return s.T.astype(">u4").tobytes()

    def unblock(self, data: bytes) -> bytes:
        s = [int.from_bytes(data[4 * i : 4 * i + 4], "big") ^ self.keys[4 * self.rounds + i] for i in range(4)]
        for r in range(self.rounds - 1, 0, -1):
            t = [BACK[s[i] >> 24] << 24 | BACK[s[(i - 1) & 3] >> 16 & 255] << 16 | BACK[s[(i - 2) & 3] >> 8 & 255] << 8 | BACK[s[(i - 3) & 3] & 255] for i in range(4)]
            s = [UNDO[0][w >> 24] ^ UNDO[1][w >> 16 & 255] ^ UNDO[2][w >> 8 & 255] ^ UNDO[3][w & 255] ^ self.back_keys[4 * r + i] for i, w in enumerate(t)]
        return b"".join(((BACK[s[i] >> 24] << 24 | BACK[s[(i - 1) & 3] >> 16 & 255] << 16 | BACK[s[(i - 2) & 3] >> 8 & 255] << 8 | BACK[s[(i - 3) & 3] & 255]) ^ self.keys[i]).to_bytes(4, "big") for i in range(4))

    def ecb(self, data: bytes, back: bool = False) -> bytes:
        return b"".join((self.unblock if back else self.block)(data[i : i + 16]) for i in range(0, len(data) - 15, 16))

    def cbc(self, data: bytes, iv: bytes) -> bytes:
        out, x = [], int.from_bytes(iv, "big")
        for i in range(0, len(data) - 15, 16):
            x = self._block(x ^ int.from_bytes(data[i : i + 16], "big"))
            out.append(x.to_bytes(16, "big"))
        return b"".join(out)

    def uncbc(self, data: bytes, iv: bytes) -> bytes:
        data = data[: len(data) // 16 * 16]
        if not data:
            return b""
        plain = self.unblocks(data) if len(data) >= AT_ONCE else self.ecb(data, True)
        return added(plain, (iv + data)[: len(data)])


def aes_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    """CBC with the vector in front and PKCS#7 padding."""
    n = 16 - len(data) % 16
    return iv + Aes(key).cbc(data + bytes([n]) * n, iv)


def aes_decrypt(key: bytes, data: bytes) -> bytes:
    if len(data) < 32:
        return b""
    out = Aes(key).uncbc(data[16:], data[:16])
    n = out[-1] if out else 0
    return out[:-n] if 1 <= n <= 16 and out.endswith(bytes([n]) * n) else out


def hash_r6(password: bytes, salt: bytes, extra: bytes) -> bytes:
    """The hardened hash of revision 6."""
    k, i = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        e = Aes(k[:16]).cbc((password + k + extra) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Security:
    """The standard handler of a file: authenticates a password and decrypts objects."""

    def __init__(self, encrypt: dict, file_id: bytes, password: str = ""):
        get = encrypt.get
        if str(get("Filter", "Standard")) != "Standard":
            raise PdfError("encryption", "unknown security handler")
        self.v, self.r = int(get("V", 0)), int(get("R", 2))
        self.o, self.u = bytes(get("O", b"")), bytes(get("U", b""))
        self.p = int(get("P", 0)) & 0xFFFFFFFF
        self.length = max(5, min(32, int(get("Length", 40)) // 8)) if self.v > 1 else 5
        self.id, self.metadata, self.dict = file_id, get("EncryptMetadata", True) is not False, encrypt
        default = "V2" if self.v < 4 else "Identity"
        filters = get("CF", {}) if isinstance(get("CF"), dict) else {}

        def method(which: str) -> str:
            name = str(get(which, "Identity"))
            if self.v < 4:
                return default
            own = filters.get(name)
            if name == "Identity" or not isinstance(own, dict):
                return "Identity"
            return str(own.get("CFM", "None"))

        self.stream_method, self.string_method = method("StmF"), method("StrF")
        if self.v == 4:
            self.length = 16
        self.key = self._open(password)
        if self.key is None:
            raise PdfError("password", "the password is wrong")

    def _open(self, password: str) -> bytes | None:
        if self.r >= 5:
            raw = password.encode()[:127]
            digest = hash_r6 if self.r >= 6 else lambda p, salt, extra: hashlib.sha256(p + salt + extra).digest()
            u = self.u[:48]
            if digest(raw, self.o[32:40], u) == self.o[:32]:
                return Aes(digest(raw, self.o[40:48], u)).uncbc(bytes(self.dict.get("OE", b""))[:32], bytes(16))
            if digest(raw, self.u[32:40], b"") == self.u[:32]:
                return Aes(digest(raw, self.u[40:48], b"")).uncbc(bytes(self.dict.get("UE", b""))[:32], bytes(16))
            return None
        raw = password.encode("latin-1", "replace")
        return self._user(raw) or self._user(self._from_owner(raw))

    def _user(self, raw: bytes) -> bytes | None:
        key = file_key(raw, self.o, self.p, self.id, self.r, self.length, self.metadata)
        want = user_entry(key, self.id, self.r)
        n = 32 if self.r == 2 else 16
        return key if want[:n] == self.u[:n] else None

    def _from_owner(self, raw: bytes) -> bytes:
        key = owner_key(raw, self.r, self.length)
        if self.r == 2:
            return rc4(key, self.o)
        return added(self.o, _layers(key, len(self.o)))

    def data(self, data: bytes, ref: Ref, method: str) -> bytes:
        if method in ("Identity", "None"):
            return data
        if method == "AESV3":
            return aes_decrypt(self.key, data)
        own = object_key(self.key, ref, method == "AESV2")
        return aes_decrypt(own, data) if method == "AESV2" else rc4(own, data)

    def open(self, value, ref: Ref):
        """value with its strings and stream decrypted."""
        if isinstance(value, Str):
            return Str(self.data(bytes(value), ref, self.string_method))
        if isinstance(value, list):
            return [self.open(v, ref) for v in value]
        if isinstance(value, dict):
            return {k: self.open(v, ref) for k, v in value.items()}
        if isinstance(value, Stream):
            kind, own = value.dict.get("Type"), self.stream_method
            if kind == "XRef" or kind == "Metadata" and not self.metadata:
                return value
            filters = value.dict.get("Filter")
            if filters == "Crypt" or isinstance(filters, list) and "Crypt" in filters:
                own = "Identity"
            return Stream(self.open(value.dict, ref), self.data(value.raw, ref, own))
        return value


def object_key(key: bytes, ref: Ref, aes: bool) -> bytes:
    own = key + ref.num.to_bytes(3, "little") + ref.gen.to_bytes(2, "little") + (b"sAlT" if aes else b"")
    return hashlib.md5(own).digest()[: min(16, len(key) + 5)]


def padded(raw: bytes) -> bytes:
    return (raw + PAD)[:32]


def file_key(raw: bytes, o: bytes, p: int, file_id: bytes, r: int, length: int, metadata: bool = True) -> bytes:
    d = hashlib.md5(padded(raw) + o[:32] + p.to_bytes(4, "little") + file_id + (b"\xff" * 4 if r >= 4 and not metadata else b"")).digest()
    if r >= 3:
        for _ in range(50):
            d = hashlib.md5(d[:length]).digest()
    return d[:length]


def user_entry(key: bytes, file_id: bytes, r: int) -> bytes:
    if r == 2:
        return rc4(key, PAD)
    return added(hashlib.md5(PAD + file_id).digest(), _layers(key, 16)) + bytes(16)


@lru_cache(maxsize=64)
def owner_key(raw: bytes, r: int, length: int) -> bytes:
    d = hashlib.md5(padded(raw)).digest()
    if r >= 3:
        for _ in range(50):
            d = hashlib.md5(d).digest()
    return d[:length]


def make_encryption(scheme: str, user: str, owner: str, file_id: bytes, permissions: int = -44) -> tuple[dict, "Security"]:
    """The Encrypt dictionary for rc4-40, rc4-128, aes-128, aes-256-r5 or aes-256, and its opened handler.

    All that should be random is derived from the passwords and the file id, so that files can be made again bit by bit.
    """
    p = permissions & 0xFFFFFFFF
    if scheme.startswith("aes-256"):
        r = 5 if scheme.endswith("r5") else 6
        digest = hash_r6 if r == 6 else lambda w, salt, extra: hashlib.sha256(w + salt + extra).digest()
        seed = lambda what, n: hashlib.shake_128(b"|".join([what, user.encode(), owner.encode(), file_id])).digest(n)
        key, us, os_ = seed(b"key", 32), seed(b"user", 16), seed(b"owner", 16)
        uw, ow = user.encode()[:127], owner.encode()[:127]
        u = digest(uw, us[:8], b"") + us
        o = digest(ow, os_[:8], u) + os_
        perms = p.to_bytes(4, "little") + b"\xff\xff\xff\xff" + b"Tadb" + seed(b"perms", 4)
        out = {"V": 5, "R": r, "Length": 256, "U": Str(u), "O": Str(o), "UE": Str(Aes(digest(uw, us[8:], b"")).cbc(key, bytes(16))), "OE": Str(Aes(digest(ow, os_[8:], u)).cbc(key, bytes(16))), "Perms": Str(Aes(key).ecb(perms)), "CF": {"StdCF": {"CFM": Name("AESV3"), "AuthEvent": Name("DocOpen"), "Length": 32}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    else:
        v, r, n = {"rc4-40": (1, 2, 5), "rc4-128": (2, 3, 16), "aes-128": (4, 4, 16)}[scheme]
        key, o = owner_key(owner.encode("latin-1"), r, n), padded(user.encode("latin-1"))
        o = rc4(key, o) if r == 2 else added(o, _layers(key, len(o)))
        u = user_entry(file_key(user.encode("latin-1"), o, p, file_id, r, n), file_id, r)
        out = {"V": v, "R": r, "Length": n * 8, "O": Str(o), "U": Str(u)}
        if v == 4:
            out |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "AuthEvent": Name("DocOpen"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    out |= {"Filter": Name("Standard"), "P": permissions}
    return out, Security(out, file_id, user)
