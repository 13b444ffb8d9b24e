"""Personal data taken out of messages before they are stored."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlake.functions.binding import once

# Handles of persons' apps, hints of merchants, and what is masked.
PERSON_HANDLES = ["okaxis", "oksbi", "okhdfcbank", "okicici", "ybl", "ibl", "axl", "apl", "upi", "paytm", "pthdfc", "ptyes", "ptaxis", "ptsbi", "fbl", "yapl", "ikwik", "freecharge", "airtel", "jupiteraxis", "naviaxis", "superyes", "slc", "kotak811"]
MERCHANT_HINT = r"(?i)(paytmqr|bharatpe|razorpay|rzp|merchant|store|shop|mart|cafe|restaurant|pvt|ltd|enterprise|traders|gpay-|^q\d{6,}|\.payu|cashfree|phonepe|swiggy|zomato)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
VPA = r"\b([A-Za-z0-9._-]{2,64})@([A-Za-z][A-Za-z0-9]{1,31})\b(?!\.[A-Za-z])"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
CARD = r"(?<![0-9])(?:[0-9]{4}[\s-]){3}([0-9]{4})(?![0-9])"
BARE_CARD = r"(?<![0-9])[0-9]{12}([0-9]{4})(?![0-9])"
AADHAAR = r"\b[2-9][0-9]{3}[\s-][0-9]{4}[\s-][0-9]{4}\b|(?i:aadhaar\D{0,12})[0-9]{12}\b"
ACCOUNT = r"(\b(?i:a/c|acct|account|ac)\.?\s*(?i:no\.?)?\s*[:\-]?\s*)[Xx*]*[0-9]{1,14}([0-9]{4})(?![0-9])"
#: What ends the 24 characters before a number that is a reference.
REFERENCE = r"(?i)(?:ref|rrn|utr|txn|upi|transaction|imps|neft|rtgs|order)(?:\s*(?:id|no|number))?[\s.:/#-]*$"
REFERENCE_CHARS = 24
PHONE = r"(?<![0-9])(?:\+91[\s-]?)?[6-9][0-9]{9}(?![0-9])"
LONG_DIGITS = r"(?<![0-9A-Za-z])[0-9]{9,}(?![0-9A-Za-z@])"


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex of the keyed hash; the key's two blocks are literals."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def is_person(local: Column, handle: Column) -> Column:
    return local.rlike("^[0-9]{10,}$") | (F.lower(handle).isin(PERSON_HANDLES) & ~local.rlike(MERCHANT_HINT))


def redact(text: Column, key: bytes) -> Column:
    """Masks e-mail addresses, identity numbers, cards, accounts, telephone and other long numbers; a person's address keeps its handle, before it a keyed hash. References and merchants' addresses stay."""

    def hashed(vpa: Column) -> Column:
        local, handle = F.split(vpa, "@")[0], F.split(vpa, "@")[1]
        return F.when(is_person(local, handle), F.concat(F.lit("p"), F.substring(hmac_sha256(key, F.lower(local)), 1, 8), F.lit("@"), handle)).otherwise(vpa)

    no_mail = F.when(text.contains("@"), F.regexp_replace(text, EMAIL, "[email]")).otherwise(text)

    def persons_hidden(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(VPA), F.lit(0)), hashed)
        return F.when(t.contains("@"), F.array_join(F.zip_with(F.split(t, VPA), found, lambda a, v: F.concat(a, F.coalesce(v, F.lit("")))), "")).otherwise(t)

    def numbers_hidden(pattern: str, mask):
        """Masks what the pattern finds unless the characters before it say that it is a reference; no reference reaches across a number, so the text since the last find tells."""

        def hidden(t: Column) -> Column:
            found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
            part = lambda a, v: F.concat(a, F.when(v.isNull(), "").when(F.right(a, F.lit(REFERENCE_CHARS)).rlike(REFERENCE), v).otherwise(mask(v)))
            return F.when(t.rlike(pattern), F.array_join(F.zip_with(F.split(t, pattern), found, part), "")).otherwise(t)

        return hidden

    out = once(no_mail, persons_hidden)
    steps = [(PAN, "[pan]"), (CARD, "XX$1"), (BARE_CARD, "XX$1"), (AADHAAR, "[aadhaar]"), (ACCOUNT, "$1XX$2")]
    out = reduce(lambda t, s: F.regexp_replace(t, *s), steps, out)
    out = once(out, numbers_hidden(PHONE, lambda v: F.lit("[phone]")))
    return once(out, numbers_hidden(LONG_DIGITS, lambda v: F.concat(F.lit("XX"), F.right(v, F.lit(4)))))
