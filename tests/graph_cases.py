"""Small graph cases: reads cut from one 120-base sequence G, and the contigs that clipping must leave (k = 9).

G[a:b] is a half-open slice, G[a:b]{p:X} the same with base p of G replaced, rc its reverse complement.
"""

import re

#: Fixed values.
G = "TCCGGAAGTCACAGTTTCAATCCCACTGATCGATGCTCTCTACACCATGCCCAAAGAAGTGGCACCCAACGCTCCGTACCTGCCCTCATGATCGAGACGACCTACGCCGACTCTTGGTAA"
CASES = {
    "200": ("G[0:120]", ""),
    "201": ("G[0:120] , G[0:9]", ""),
    "201RC": ("rc G[0:120] , rc G[0:9]", ""),
    "202": ("G[0:120] , G[111:120]", ""),
    "203": ("G[0:120] , G[0:10]", ""),
    "204": ("G[0:120] , G[110:120]", ""),
    "205": ("G[0:120] , G[109:119]", ""),
    "206": ("G[0:120] , G[0:9] , G[111:120]", ""),
    "207": ("G[0:120] , G[0:120]", "G[0:120]"),
    "210": ("G[0:119] , G[110:120] , G[110:120]{119:G}", ""),
    "211": ("G[0:120] , G[0:10]{0:C}", ""),
    "212": ("G[0:120] , G[0:10] , G[0:10]{0:C}", ""),
    "213": ("G[0:120] , G[110:120] , G[110:120]{119:G}", ""),
    "214": ("G[0:120] , G[0:11]{0:C} , G[110:120]", "G[1:120]"),
    "215": ("G[0:120] , G[0:10]{0:C} , G[0:9] , G[110:120]", ""),
    "216": ("G[0:120] , G[0:10]{0:C} , G[0:10] , G[110:120]", "G[0:120]"),
    "220": ("G[0:118] , G[0:10] , G[108:120] , G[110:120] , G[108:120]{118:G} , G[110:120]{118:G}", "G[0:118]"),
    "222": ("G[2:120] , G[0:12] , G[0:10] , G[0:12]{1:T} , G[0:10]{1:T} , G[110:120]", "G[2:120]"),
    "224": ("G[0:118] , G[0:10] , G[108:120] , G[110:120] , G[108:120]{118:G} , G[110:120]{118:G} , G[108:120]{118:C} , G[110:120]{118:C}", "G[0:118]"),
    "226": ("G[2:120] , G[0:12] , G[0:10] , G[0:12]{1:T} , G[0:10]{1:T} , G[0:12]{1:G} , G[0:10]{1:G} , G[110:120]", "G[2:120]"),
    "300": ("G[0:120] , G[0:120]", "G[0:120]"),
    "301": ("G[0:120] , G[0:120] , G[0:9]", "G[0:120]"),
    "301RC": ("rc G[0:120] , rc G[0:120] , rc G[0:9]", "G[0:120]"),
    "302": ("G[0:120] , G[0:120] , G[111:120]", "G[0:120]"),
    "303": ("G[0:120] , G[0:120] , G[0:10]", "G[0:120]"),
    "304": ("G[0:120] , G[0:120] , G[110:120]", "G[0:120]"),
    "305": ("G[0:120] , G[0:120] , G[109:119]", "G[0:120]"),
    "306": ("G[0:120] , G[0:120] , G[0:9] , G[111:120]", "G[0:120]"),
    "307": ("G[0:120] , G[0:120] , G[0:120]", "G[0:120]"),
    "310": ("G[0:119] , G[0:119] , G[110:120] , G[110:120] , G[110:120]{119:G} , G[110:120]{119:G}", "G[0:119] , G[111:120] , G[111:120]{119:G}"),
    "311": ("G[0:120] , G[0:120] , G[0:10]{0:C} , G[0:10]{0:C}", "G[1:120] , G[0:9] , G[0:9]{0:C}"),
    "312": ("G[0:120] , G[0:120] , G[0:10] , G[0:10]{0:C}", "G[0:120]"),
    "313": ("G[0:120] , G[0:120] , G[110:120] , G[110:120]{119:G}", "G[0:120]"),
    "314": ("G[0:120] , G[0:120] , G[0:11]{0:C} , G[0:11]{0:C} , G[110:120]", "G[1:120] , G[0:9] , G[0:9]{0:C}"),
    "315": ("G[0:120] , G[0:120] , G[0:10]{0:C} , G[0:10]{0:C} , G[0:9] , G[0:9] , G[110:120]", "G[1:120] , G[0:9] , G[0:9]{0:C}"),
    "316": ("G[0:120] , G[0:120] , G[0:10]{0:C} , G[0:10] , G[110:120]", "G[0:120]"),
    "400": ("G[0:120] , G[0:120]{15:A}", "G[0:15] , G[7:24] , G[7:24]{15:A} , G[16:120]"),
    "401": ("G[6:120] , G[6:120]{15:A}", "G[6:15] , G[7:24] , G[7:24]{15:A} , G[16:120]"),
    "2051": ("G[0:120] , G[1:11]", ""),
    "2052": ("G[0:120] , G[1:11] , G[109:119]", "G[1:119]"),
    "2061": ("G[0:120] , G[0:10] , G[110:120]", "G[0:120]"),
    "3051": ("G[0:120] , G[0:120] , G[1:11]", "G[0:120]"),
    "3052": ("G[0:120] , G[0:120] , G[1:11] , G[109:119]", "G[0:120]"),
    "3061": ("G[0:120] , G[0:120] , G[0:10] , G[110:120]", "G[0:120]"),
}


def sequences(text: str) -> list[str]:
    found = []
    for rc, a, b, at, base in re.findall(r"(rc )?G\[(\d+):(\d+)\](?:\{(\d+):([ACGT])\})?", text):
        s = list(G)
        if at:
            s[int(at)] = base
        piece = "".join(s[int(a) : int(b)])
        found.append(piece.translate(str.maketrans("ACGT", "TGCA"))[::-1] if rc else piece)
    return found
