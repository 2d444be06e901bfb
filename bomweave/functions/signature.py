"""Signatures of component descriptors: normalisation, RSA verification by integer arithmetic, keys from PEM."""

from __future__ import annotations

import base64
import hashlib
import json
import re

#: DER prefixes of a digest in a PKCS #1 v1.5 signature, and object ids of RSA keys.
DIGEST_INFO = {"sha256": bytes.fromhex("3031300d060960864801650304020105000420"), "sha512": bytes.fromhex("3051300d060960864801650304020305000440")}
RSA_OIDS = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a"))
#: Pinned keys, at most, and bytes of them (and of one key).
MAX_KEYS, MAX_KEY_BYTES = 16, 64 << 10


class BadInput(ValueError):
    """A descriptor or key that cannot be used."""


def _item(data: bytes, at: int) -> tuple[int, int, int]:
    """(tag, start of the content, end) of the DER item at a place."""
    if at + 2 > len(data):
        raise BadInput("DER ends early")
    tag, n, start = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        n, start = int.from_bytes(data[start : start + size], "big"), start + size
    if start + n > len(data):
        raise BadInput("DER ends early")
    return tag, start, start + n


def _items(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(data):
        tag, start, end = _item(data, at)
        out.append((tag, data[start:end]))
        at = end
    return out


def _rsa_numbers(data: bytes) -> tuple[int, int]:
    parts = _items(_items(data)[0][1])
    if len(parts) < 2 or any(t != 2 for t, _ in parts[:2]):
        raise BadInput("no RSA key")
    return int.from_bytes(parts[0][1], "big"), int.from_bytes(parts[1][1], "big")


def _spki_numbers(data: bytes) -> tuple[int, int]:
    (_, algorithm), (tag, bits), *_ = _items(data)
    if tag != 3 or _items(algorithm)[0][1] not in RSA_OIDS:
        raise BadInput("no RSA key")
    return _rsa_numbers(bits[1:])


def rsa_key(pem: str) -> tuple[int, int]:
    """Modulus and exponent of a public key, an RSA public key or a certificate."""
    if len(pem) > MAX_KEY_BYTES:
        raise BadInput("the key is too large")
    m = re.search(r"-----BEGIN (PUBLIC KEY|RSA PUBLIC KEY|CERTIFICATE)-----(.*?)-----END \1-----", pem, re.S)
    if not m:
        raise BadInput("no public key or certificate")
    try:
        data = base64.b64decode(re.sub(r"\s", "", m[2]), validate=True)
    except ValueError as e:
        raise BadInput(str(e)) from None
    if m[1] == "RSA PUBLIC KEY":
        return _rsa_numbers(data)
    body = _items(data)[0][1]
    if m[1] == "PUBLIC KEY":
        return _spki_numbers(body)
    fields = _items(_items(body)[0][1])
    if fields[0][0] == 0xA0:
        fields = fields[1:]
    return _spki_numbers(fields[5][1])


def _mask(seed: bytes, n: int, name: str) -> bytes:
    return b"".join(hashlib.new(name, seed + i.to_bytes(4, "big")).digest() for i in range(-(-n // hashlib.new(name).digest_size)))[:n]


def verify_pkcs1(key: tuple[int, int], digest: bytes, signature: bytes, name: str) -> bool:
    n, e = key
    size = (n.bit_length() + 7) // 8
    if len(signature) != size or int.from_bytes(signature, "big") >= n:
        return False
    padded = pow(int.from_bytes(signature, "big"), e, n).to_bytes(size, "big")
    tail = DIGEST_INFO[name] + digest
    return padded == b"\0\1" + b"\xff" * (size - len(tail) - 3) + b"\0" + tail


def verify_pss(key: tuple[int, int], digest: bytes, signature: bytes, name: str) -> bool:
    """PSS with a salt of the greatest size, else of the hash's size."""
    n, e = key
    size, bits = (n.bit_length() + 7) // 8, n.bit_length() - 1
    if len(signature) != size or int.from_bytes(signature, "big") >= n:
        return False
    length = (bits + 7) // 8
    value = pow(int.from_bytes(signature, "big"), e, n)
    if value.bit_length() > 8 * length:
        return False
    message, h = value.to_bytes(length, "big"), len(digest)
    if message[-1:] != b"\xbc" or length < h + 2:
        return False
    masked, own = message[: length - h - 1], message[length - h - 1 : -1]
    block = bytearray(a ^ b for a, b in zip(masked, _mask(own, len(masked), name), strict=True))
    spare = 8 * length - bits
    if masked[0] >> (8 - spare) if spare else 0:
        return False
    block[0] &= 0xFF >> spare
    for salt in (length - h - 2, h):
        zeros = length - h - salt - 2
        if 0 <= zeros and not any(block[:zeros]) and block[zeros : zeros + 1] == b"\1" and hashlib.new(name, bytes(8) + digest + bytes(block[zeros + 1 :])).digest() == own:
            return True
    return False


#: What is left out of the signed bytes, and the parts of a signed label.
UNSIGNED_COMPONENT, UNSIGNED_ARTIFACT, LABEL_PARTS = ("repositoryContexts",), ("access", "srcRefs"), ("name", "version", "value", "signing")
ALGORITHMS = ("jsonNormalisation/v2", "jsonNormalisation/v3", "jsonNormalisation/v4alpha1")


def _canonical(value: object) -> object:
    """The value with maps in order of their keys (by UTF-16 units) and whole numbers as integers; other numbers are refused."""
    if isinstance(value, dict):
        return {k: _canonical(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
    if isinstance(value, list):
        return [_canonical(v) for v in value]
    if isinstance(value, float):
        if not value.is_integer():
            raise BadInput("a number that is no integer")
        return int(value)
    return value


def _without(entry: object, unsigned: tuple[str, ...]) -> object:
    """A map without its unsigned parts: the named ones, and labels that aren't marked as signed."""
    if not isinstance(entry, dict):
        return entry
    out = {k: v for k, v in entry.items() if k not in (*unsigned, "labels")}
    labels = entry.get("labels")
    signed = [{p: x[p] for p in LABEL_PARTS if p in x} for x in labels if isinstance(x, dict) and x.get("signing") in (True, "true")] if isinstance(labels, list) else []
    return out | ({"labels": signed} if signed else {})


def normalized(component: dict, algorithm: str) -> bytes:
    """The bytes of a component that are signed: all that isn't excluded, as compact JSON with sorted keys.

    The three lists of artifacts are there even if empty, and a provider given by name is a map.
    """
    if algorithm not in ALGORITHMS:
        raise BadInput(f"{algorithm} is not known")
    out = dict(_without(component, UNSIGNED_COMPONENT))
    if "provider" in out and not isinstance(out["provider"], dict):
        out["provider"] = {"name": out["provider"]}
    for key, unsigned in (("resources", UNSIGNED_ARTIFACT), ("sources", UNSIGNED_ARTIFACT), ("componentReferences", ()), ("references", ())):
        if key in out or key != "references":
            out[key] = [_without(a, unsigned) for a in out[key]] if isinstance(out.get(key), list) else []
    return json.dumps(_canonical({"component": out}), separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")


def verify(component: dict, signature: dict, pem: str) -> dict[str, object]:
    """state (valid, invalid or unverifiable), digest_match and reason of one recorded signature."""
    digest, own = signature.get("digest") or {}, signature.get("signature") or {}
    name = str(digest.get("hashAlgorithm", "")).lower().replace("-", "")
    try:
        if name not in DIGEST_INFO:
            raise BadInput(f"hash {name} is not known")
        key = rsa_key(pem)
        recorded = bytes.fromhex(str(digest.get("value", "")))
        computed = hashlib.new(name, normalized(component, str(digest.get("normalisationAlgorithm")))).digest()
        value = str(own.get("value", ""))
        raw = base64.b64decode(re.sub("-----[^-]+-----|[^:\n]+:[^\n]+\n|\\s", "", value)) if "-----" in value else bytes.fromhex(value)
        check = {"RSASSA-PSS": verify_pss, "RSASSA-PKCS1-V1_5": verify_pkcs1}.get(str(own.get("algorithm", "")).upper())
        if check is None:
            raise BadInput(f"signature {own.get('algorithm')} is not known")
    except (BadInput, ValueError, IndexError) as e:
        return {"state": "unverifiable", "digest_match": None, "reason": str(e)}
    match = computed == recorded
    good = check(key, recorded, raw, name)
    return {"state": "valid" if good and match else "invalid", "digest_match": match, "reason": None if good and match else "the signature is not of this digest" if not good else "the descriptor is not the one that was signed"}


def pin(keys: dict[str, str], label: str, pem: str) -> dict[str, str]:
    """The trusted keys (PEM by label) with one more; a label that is there already gets the new key, in the last place."""
    name = label.strip()
    if not name:
        raise BadInput("a key needs a label")
    rsa_key(pem)
    out = {k: v for k, v in keys.items() if k != name} | {name: pem}
    if len(out) > MAX_KEYS:
        raise BadInput(f"at most {MAX_KEYS} keys")
    if len(json.dumps([{"label": k, "pem": v} for k, v in out.items()], separators=(",", ":"), ensure_ascii=False)) > MAX_KEY_BYTES:
        raise BadInput("the keys are too large")
    return out


def unpin(keys: dict[str, str], label: str) -> dict[str, str]:
    return {k: v for k, v in keys.items() if k != label}


def verify_pinned(component: dict, signature: dict, keys: dict[str, str]) -> dict[str, object]:
    """verify() by the first pinned key under which the signature is valid, with its label; else what the last one gave."""
    out: dict[str, object] = {"state": "unverifiable", "digest_match": None, "reason": "no key is pinned"}
    for label, pem in keys.items():
        out = verify(component, signature, pem)
        if out["state"] == "valid":
            return out | {"label": label}
    return out | {"label": None}
