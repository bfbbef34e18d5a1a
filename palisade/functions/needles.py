"""Plain substrings without which a pattern cannot match.

Looking for a substring costs a fraction of a case-blind pattern, and most files have none of them. For each pattern a
list of alternatives; an alternative is the substrings, in lower case, that it needs together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import fixed
from palisade.functions.regex import first_match, matches

NEEDLES: dict[str, list[list[str]]] = {
    fixed.PRIVATE_KEY: [["private key-----"]],
    fixed.AWS_KEY: [["akia"]],
    fixed.GENERIC_SECRET: [["secret"], ["token"], ["api"], ["passw"]],
    fixed.DYN_EXEC_DECODED: [["b64decode"], ["atob"], ["unescape"], ["fromcharcode"], ["buffer.from"]],
    fixed.NET_PRIMITIVE: [["request"], ["fetch"], ["websocket"], ["net."], ["socket.socket"], ["urllib"], [".connect"], ["axios"], ["curl "], ["wget "], ["require("]],
    fixed.REV_SHELL_IDIOM: [["/dev/tcp/"], ["/dev/udp/"], ["sh", "-i"], ["nc", "-c"], ["nc", "-e"], ["mkfifo"], ["socat"]],
    fixed.REV_SHELL_CONNECT: [["net."], ["socket.socket"], [".connect"]],
    fixed.REV_SHELL_BIND: [["dup2"], ["stdio"], [".pipe"]],
    fixed.REV_SHELL_TARGET: [["/bin/"], ["pty.spawn"], ["cmd.exe"]],
    fixed.STRATUM: [["stratum+"]],
    fixed.MINER_BINARY: [["xmr"], ["miner"], ["t-rex"]],
    fixed.MINER_CONFIG: [["randomx"], ["cryptonight"], ["--donate-level"], ["--nicehash"], ["--coin"]],
    fixed.DESTRUCTIVE: [["rm", "-r"], ["rm", "-f"], ["mkfs"], ["of=/dev/"], ["/dev/sd"], ["shred"], ["rmsync"], ["rmdirsync"], ["rmtree"]],
    fixed.ENV_EXFIL_SEND: [["process.env"], ["os.environ"]],
    fixed.HOST_RECON: [["os."], ["process.env"], ["gethostname"], ["getuser"], ["uname"], ["whoami"]],
    fixed.SHELL_RECON_EXFIL: [["whoami"], ["$("], ["/etc/passwd"], ["/etc/shadow"], ["/.ssh/"], [".aws/credentials"], [".ssh/id_"]],
    fixed.WEBHOOK: [["discord"], ["api.telegram.org"]],
    fixed.HEX_IDENTIFIER: [["_0x"]],
    fixed.ESCAPE_SEQUENCE: [["\\"]],
    fixed.PY_ESCAPED_EVAL: [["eval", "\\"], ["exec", "\\"]],
    fixed.EVAL_MARKER: [["eval"], ["new"], ["atob"], ["b64decode"], ["fromcharcode"]],
}


def likely(low: Column, pattern: str) -> Column:
    """Whether the text, given in lower case, has what the pattern needs; true where nothing is known."""
    ways = [reduce(lambda a, b: a & b, [low.contains(n) for n in way]) for way in NEEDLES.get(pattern, [])]
    return reduce(lambda a, b: a | b, ways) if ways else F.lit(True)


def found(text: Column, low: Column, pattern: str) -> Column:
    return likely(low, pattern) & matches(text, pattern)


def first_found(text: Column, low: Column, pattern: str) -> Column:
    return F.when(likely(low, pattern), first_match(text, pattern)).otherwise("")
