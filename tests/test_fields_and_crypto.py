import hashlib
import hmac
import json
import math

import pytest
from pyspark.sql import functions as F

from veilspan.functions import crypto
from veilspan.functions.fields import extract_fields, strip_syslog_header
from veilspan.operators import bloom

DEEP = '{"l1": ' * 30 + '"bottom"' + "}" * 30
CASES = [
    ("windows_event", "EventID=4740 Owner=Sarah Young IpAddress=172.16.0.4", {"EventID": "4740", "Owner": "Sarah Young", "IpAddress": "172.16.0.4"}),
    ("windows_event", "A=1 B=2 A=3", {"A": "3", "B": "2"}),
    ("windows_event", "nothing", {}),
    ("syslog", "sshd[1]: Failed password for invalid user bob from 1.2.3.4 port 22 ssh2", {"sshd.user": "bob", "sshd.src_ip": "1.2.3.4", "sshd.port": "22"}),
    ("syslog", "sshd[1]: Failed password for bob from 1.2.3.4 port 22 ssh2", {"sshd.user": "bob", "sshd.src_ip": "1.2.3.4", "sshd.port": "22"}),
    ("syslog", "sshd[1]: Accepted password for bob from 1.2.3.4 port 22 ssh2", {"sshd.user": "bob", "sshd.src_ip": "1.2.3.4", "sshd.port": "22"}),
    ("syslog", "sshd[1]: Accepted publickey for bob from 1.2.3.4 port 22 ssh2", {"sshd.user": "bob", "sshd.src_ip": "1.2.3.4", "sshd.port": "22"}),
    ("syslog", "sshd[1]: Invalid user bob from 1.2.3.4", {"sshd.user": "bob", "sshd.src_ip": "1.2.3.4"}),
    ("syslog", "sshd[1]: User bob from host7 not allowed because of its shell", {"sshd.user": "bob", "sshd.src_ip": "host7"}),
    ("syslog", "sshd[1]: Disconnected from user bob 1.2.3.4 port 9", {"sshd.user": "bob", "sshd.src_ip": "1.2.3.4", "sshd.port": "9"}),
    ("syslog", "sshd[1]: Disconnected from authenticating user bob 1.2.3.4 port 9 [preauth]", {"sshd.user": "bob", "sshd.src_ip": "1.2.3.4", "sshd.port": "9"}),
    ("syslog", "su[3]: pam_unix(su:session): session opened for user root by bob(uid=7)", {"su.user": "bob"}),
    ("syslog", "dhclient[2]: DHCPACK from 172.16.0.1", {"dhclient.src_ip": "172.16.0.1"}),
    ("syslog", "dhclient[2]: DHCPOFFER from 172.16.0.1", {"dhclient.src_ip": "172.16.0.1"}),
    ("syslog", "systemd-logind[4]: New session 81 of user carol.", {"systemd-logind.session_id": "81", "systemd-logind.user": "carol"}),
    ("syslog", "cron[1]: (carol) CMD ( /opt/run --all )", {"cron.user": "carol", "cron.command": "/opt/run --all"}),
    ("syslog", "cron[1]: (root) RELOAD (tabs/carol)", {"cron.user": "root", "cron.crontab": "tabs/carol"}),
    ("syslog", "systemd[1]: sync.service: Failed with result 'timeout'.", {"systemd.unit": "sync.service", "systemd.result": "timeout"}),
    ("syslog", "NetworkManager[9]: <info>  [7.25] dhcp4 (enp3s0): address 172.16.0.9", {"NetworkManager.iface": "enp3s0", "NetworkManager.src_ip": "172.16.0.9"}),
    ("syslog", "NetworkManager[9]: <info>  [7.25] device (wlp2s0): Activation: (wifi) connected to 'the attic'", {"NetworkManager.iface": "wlp2s0", "NetworkManager.ssid": "the attic"}),
    ("syslog", "ftpd(pam_unix)[88]: login refused; user= uid=0 host=172.16.0.4 ;,", {"ftpd.user": "", "ftpd.uid": "0", "ftpd.host": "172.16.0.4"}),
    ("syslog", "adduser[1]: added: name=carol, UID=5, GID=6", {"adduser.name": "carol", "adduser.UID": "5", "adduser.GID": "6"}),
    ("syslog", "ftpd[pam_unix][1]: login refused; user=x", {}),
    ("syslog", "no tag here", {}),
    ("cloudtrail", '{"z": "1", "a": {"b": "x", "n": 3, "l": ["q"], "t": true, "o": {"p": "deep", "e": ""}}, "N": null}', {"z": "1", "a.b": "x", "a.o.p": "deep", "a.o.e": ""}),
    ("cloudtrail", DEEP, {".".join(["l1"] * 30): "bottom"}),
    ("cloudtrail", '{"source": "s3", "a": "source"}', {"source": "s3", "a": "source"}),
    ("cloudtrail", '{"x": "one", "y": "q\\"z", "w": "\\u00e9\\ud83d\\ude00"}', {"x": "one", "y": 'q"z', "w": "é😀"}),
    ("cloudtrail", '{"k": "first", "m": "2", "k": "last"}', {"k": "last", "m": "2"}),
    ("cloudtrail", '{"a": "\\ud800"}', {"a": "?"}),
    ("cloudtrail", "no json", {}),
    ("cloudtrail", "", {}),
    ("cloudtrail", '"bare"', {"": "bare"}),
    ("cloudtrail", None, {}),
    ("unknown", "A=1", {}),
    (None, "A=1", {}),
]


def test_fields_in_the_order_of_the_line(spark):
    df = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(CASES)], "i int, k string, t string")
    got = df.select("i", extract_fields(F.col("k"), F.col("t")).alias("f")).orderBy("i").collect()
    for (_, text, want), row in zip(CASES, got, strict=True):
        assert [(f["field"], f["value"]) for f in row["f"]] == list(want.items()), text
        assert [f["pos"] for f in row["f"]] == list(range(len(want)))


def test_syslog_header(spark):
    r = spark.createDataFrame([("Feb  3 11:12:13 gate sshd[1]: x",), ("plain",)], "t string").select(strip_syslog_header(F.col("t")).alias("s")).collect()
    assert [tuple(x["s"]) for x in r] == [(21, "sshd[1]: x"), (0, "plain")]


def test_hmac(spark):
    values = ["a", "", "é😀", "x" * 500]
    for key in ("k", "long" * 40):
        got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(crypto.hmac_sha256(key, F.col("v"))).collect()]
        assert got == [hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest() for v in values]
    with pytest.raises(ValueError):
        crypto.hmac_sha256("", F.lit("x"))


def test_aes_and_format_preserving_encryption(spark):
    import numpy as np

    block = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8).reshape(1, 16)
    for key, want in (("000102030405060708090a0b0c0d0e0f", "69c4e0d86a7b0430d8cdb78070b4c55a"), ("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f", "8ea2b7ca516745bfeafc49904b496089")):
        assert bytes(crypto.AesBlocks(bytes.fromhex(key)).encrypt(block)[0]).hex() == want
    key, tweak = "EF4359D8D580AA4F7F036D6F04FC6A94", "D8E7920AFA330A"
    assert crypto.DigitCipher(key, tweak).encrypt(["890121234567890000"]) == ["477064185124354662"]
    values = ["321-54-9876", "5200 0011 1122 3344", "12345", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("c", crypto.encrypt_digits(F.col("v"), key, tweak))
    rows = df.select("v", "c", crypto.decrypt_digits(F.col("c"), key, tweak).alias("b")).collect()
    assert [r["b"] for r in rows] == [values[0], values[1], None, None]
    assert rows[0]["c"][3] == "-" and rows[0]["c"] != values[0] and rows[1]["c"][4] == " "


def test_bloom(spark, tmp_path):
    for bad in (("", 1, 0.1), ("p", 0, 0.1), ("p", 1, 1.0)):
        with pytest.raises(ValueError):
            bloom.sizing(*bad)
    size = bloom.sizing("pepper", 500, 0.01)
    names = spark.range(500).select(F.concat(F.lit("Name  Number "), F.col("id").cast("string")).alias("name"))
    got = [r[0] for r in names.limit(3).select(bloom.positions(F.col("name"), "pepper", size)).collect()]
    for name, positions in zip([r[0] for r in names.limit(3).collect()], got, strict=True):
        digest = hmac.new(b"pepper", " ".join(name.lower().split()).encode(), hashlib.sha256).digest()
        h1, h2 = int.from_bytes(digest[:16], "big"), int.from_bytes(digest[16:], "big")
        assert positions == [(h1 + i * h2) % size.num_bits for i in range(size.num_hashes)]
    built = bloom.build(names, "pepper", size)
    bloom.save(built, size, str(tmp_path / "f"))
    loaded, loaded_size = bloom.load(spark, str(tmp_path / "f"))
    assert loaded_size == size
    asked = names.select(F.upper("name").alias("token")).union(spark.range(1000).select(F.concat(F.lit("other"), F.col("id").cast("string"))))
    found = {r["token"]: r["might_contain"] for r in bloom.might_contain(asked, loaded, "pepper", size).collect()}
    assert all(v for k, v in found.items() if k.startswith("NAME")) and sum(v for k, v in found.items() if k.startswith("other")) < 40
    assert bloom.estimated_error_rate(size, 500) == pytest.approx((1 - math.exp(-size.num_hashes * 500 / size.num_bits)) ** size.num_hashes)
