"""The 166 structural keys (MACCS) as patterns."""

from __future__ import annotations

# The public key definitions, in order of their numbers: pattern (? for the keys that no pattern defines).
PATTERNS = [
    "?",  # 1
    "[#104]",  # 2
    "[#32,#33,#34,#50,#51,#52,#82,#83,#84]",  # 3
    "[Ac,Th,Pa,U,Np,Pu,Am,Cm,Bk,Cf,Es,Fm,Md,No,Lr]",  # 4
    "[Sc,Ti,Y,Zr,Hf]",  # 5
    "[La,Ce,Pr,Nd,Pm,Sm,Eu,Gd,Tb,Dy,Ho,Er,Tm,Yb,Lu]",  # 6
    "[V,Cr,Mn,Nb,Mo,Tc,Ta,W,Re]",  # 7
    "[!#6;!#1]1~*~*~*~1",  # 8
    "[Fe,Co,Ni,Ru,Rh,Pd,Os,Ir,Pt]",  # 9
    "[Be,Mg,Ca,Sr,Ba,Ra]",  # 10
    "*1~*~*~*~1",  # 11
    "[Cu,Zn,Ag,Cd,Au,Hg]",  # 12
    "[#8]~[#7](~[#6])~[#6]",  # 13
    "[#16]-[#16]",  # 14
    "[#8]~[#6](~[#8])~[#8]",  # 15
    "[!#6;!#1]1~*~*~1",  # 16
    "[#6]#[#6]",  # 17
    "[#5,#13,#31,#49,#81]",  # 18
    "*1~*~*~*~*~*~*~1",  # 19
    "[#14]",  # 20
    "[#6]=[#6](~[!#6;!#1])~[!#6;!#1]",  # 21
    "*1~*~*~1",  # 22
    "[#7]~[#6](~[#8])~[#8]",  # 23
    "[#7]-[#8]",  # 24
    "[#7]~[#6](~[#7])~[#7]",  # 25
    "[#6]=;@[#6](@*)@*",  # 26
    "[I]",  # 27
    "[!#6;!#1]~[CH2]~[!#6;!#1]",  # 28
    "[#15]",  # 29
    "[#6]~[!#6;!#1](~[#6])(~[#6])~*",  # 30
    "[!#6;!#1]~[F,Cl,Br,I]",  # 31
    "[#6]~[#16]~[#7]",  # 32
    "[#7]~[#16]",  # 33
    "[CH2]=*",  # 34
    "[Li,Na,K,Rb,Cs,Fr]",  # 35
    "[#16R]",  # 36
    "[#7]~[#6](~[#8])~[#7]",  # 37
    "[#7]~[#6](~[#6])~[#7]",  # 38
    "[#8]~[#16](~[#8])~[#8]",  # 39
    "[#16]-[#8]",  # 40
    "[#6]#[#7]",  # 41
    "F",  # 42
    "[!#6;!#1;!H0]~*~[!#6;!#1;!H0]",  # 43
    "[!#1;!#6;!#7;!#8;!#9;!#14;!#15;!#16;!#17;!#35;!#53]",  # 44
    "[#6]=[#6]~[#7]",  # 45
    "Br",  # 46
    "[#16]~*~[#7]",  # 47
    "[#8]~[!#6;!#1](~[#8])(~[#8])",  # 48
    "[!+0]",  # 49
    "[#6]=[#6](~[#6])~[#6]",  # 50
    "[#6]~[#16]~[#8]",  # 51
    "[#7]~[#7]",  # 52
    "[!#6;!#1;!H0]~*~*~*~[!#6;!#1;!H0]",  # 53
    "[!#6;!#1;!H0]~*~*~[!#6;!#1;!H0]",  # 54
    "[#8]~[#16]~[#8]",  # 55
    "[#8]~[#7](~[#8])~[#6]",  # 56
    "[#8R]",  # 57
    "[!#6;!#1]~[#16]~[!#6;!#1]",  # 58
    "[#16]!:*:*",  # 59
    "[#16]=[#8]",  # 60
    "*~[#16](~*)~*",  # 61
    "*@*!@*@*",  # 62
    "[#7]=[#8]",  # 63
    "*@*!@[#16]",  # 64
    "c:n",  # 65
    "[#6]~[#6](~[#6])(~[#6])~*",  # 66
    "[!#6;!#1]~[#16]",  # 67
    "[!#6;!#1;!H0]~[!#6;!#1;!H0]",  # 68
    "[!#6;!#1]~[!#6;!#1;!H0]",  # 69
    "[!#6;!#1]~[#7]~[!#6;!#1]",  # 70
    "[#7]~[#8]",  # 71
    "[#8]~*~*~[#8]",  # 72
    "[#16]=*",  # 73
    "[CH3]~*~[CH3]",  # 74
    "*!@[#7]@*",  # 75
    "[#6]=[#6](~*)~*",  # 76
    "[#7]~*~[#7]",  # 77
    "[#6]=[#7]",  # 78
    "[#7]~*~*~[#7]",  # 79
    "[#7]~*~*~*~[#7]",  # 80
    "[#16]~*(~*)~*",  # 81
    "*~[CH2]~[!#6;!#1;!H0]",  # 82
    "[!#6;!#1]1~*~*~*~*~1",  # 83
    "[NH2]",  # 84
    "[#6]~[#7](~[#6])~[#6]",  # 85
    "[C;H2,H3][!#6;!#1][C;H2,H3]",  # 86
    "[F,Cl,Br,I]!@*@*",  # 87
    "[#16]",  # 88
    "[#8]~*~*~*~[#8]",  # 89
    "[$([!#6;!#1;!H0]~*~*~[CH2]~*),$([!#6;!#1;!H0;R]1@[R]@[R]@[CH2;R]1),$([!#6;!#1;!H0]~[R]1@[R]@[CH2;R]1)]",  # 90
    "[$([!#6;!#1;!H0]~*~*~*~[CH2]~*),$([!#6;!#1;!H0;R]1@[R]@[R]@[R]@[CH2;R]1),$([!#6;!#1;!H0]~[R]1@[R]@[R]@[CH2;R]1),$([!#6;!#1;!H0]~*~[R]1@[R]@[CH2;R]1)]",  # 91
    "[#8]~[#6](~[#7])~[#6]",  # 92
    "[!#6;!#1]~[CH3]",  # 93
    "[!#6;!#1]~[#7]",  # 94
    "[#7]~*~*~[#8]",  # 95
    "*1~*~*~*~*~1",  # 96
    "[#7]~*~*~*~[#8]",  # 97
    "[!#6;!#1]1~*~*~*~*~*~1",  # 98
    "[#6]=[#6]",  # 99
    "*~[CH2]~[#7]",  # 100
    "[$([R]@1@[R]@[R]@[R]@[R]@[R]@[R]@[R]1),$([R]@1@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]1),$([R]@1@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]1),$([R]@1@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]1),$([R]@1@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]1),$([R]@1@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]1),$([R]@1@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]@[R]1)]",  # 101
    "[!#6;!#1]~[#8]",  # 102
    "Cl",  # 103
    "[!#6;!#1;!H0]~*~[CH2]~*",  # 104
    "*@*(@*)@*",  # 105
    "[!#6;!#1]~*(~[!#6;!#1])~[!#6;!#1]",  # 106
    "[F,Cl,Br,I]~*(~*)~*",  # 107
    "[CH3]~*~*~*~[CH2]~*",  # 108
    "*~[CH2]~[#8]",  # 109
    "[#7]~[#6]~[#8]",  # 110
    "[#7]~*~[CH2]~*",  # 111
    "*~*(~*)(~*)~*",  # 112
    "[#8]!:*:*",  # 113
    "[CH3]~[CH2]~*",  # 114
    "[CH3]~*~[CH2]~*",  # 115
    "[$([CH3]~*~*~[CH2]~*),$([CH3]~*1~*~[CH2]1)]",  # 116
    "[#7]~*~[#8]",  # 117
    "[$(*~[CH2]~[CH2]~*),$(*1~[CH2]~[CH2]1)]",  # 118
    "[#7]=*",  # 119
    "[!#6;R]",  # 120
    "[#7;R]",  # 121
    "*~[#7](~*)~*",  # 122
    "[#8]~[#6]~[#8]",  # 123
    "[!#6;!#1]~[!#6;!#1]",  # 124
    "?",  # 125
    "*!@[#8]!@*",  # 126
    "*@*!@[#8]",  # 127
    "[$(*~[CH2]~*~*~*~[CH2]~*),$([R]1@[CH2;R]@[R]@[R]@[R]@[CH2;R]1),$(*~[CH2]~[R]1@[R]@[R]@[CH2;R]1),$(*~[CH2]~*~[R]1@[R]@[CH2;R]1)]",  # 128
    "[$(*~[CH2]~*~*~[CH2]~*),$([R]1@[CH2]@[R]@[R]@[CH2;R]1),$(*~[CH2]~[R]1@[R]@[CH2;R]1)]",  # 129
    "[!#6;!#1]~[!#6;!#1]",  # 130
    "[!#6;!#1;!H0]",  # 131
    "[#8]~*~[CH2]~*",  # 132
    "*@*!@[#7]",  # 133
    "[F,Cl,Br,I]",  # 134
    "[#7]!:*:*",  # 135
    "[#8]=*",  # 136
    "[!C;!c;R]",  # 137
    "[!#6;!#1]~[CH2]~*",  # 138
    "[O;!H0]",  # 139
    "[#8]",  # 140
    "[CH3]",  # 141
    "[#7]",  # 142
    "*@*!@[#8]",  # 143
    "*!:*:*!:*",  # 144
    "*1~*~*~*~*~*~1",  # 145
    "[#8]",  # 146
    "[$(*~[CH2]~[CH2]~*),$([R]1@[CH2;R]@[CH2;R]1)]",  # 147
    "*~[!#6;!#1](~*)~*",  # 148
    "[C;H3,H4]",  # 149
    "*!@*@*!@*",  # 150
    "[#7;!H0]",  # 151
    "[#8]~[#6](~[#6])~[#6]",  # 152
    "[!#6;!#1]~[CH2]~*",  # 153
    "[#6]=[#8]",  # 154
    "*!@[CH2]!@*",  # 155
    "[#7]~*(~*)~*",  # 156
    "[#6]-[#8]",  # 157
    "[#6]-[#7]",  # 158
    "[#8]",  # 159
    "[C;H3,H4]",  # 160
    "[#7]",  # 161
    "a",  # 162
    "*1~*~*~*~*~*~1",  # 163
    "[#8]",  # 164
    "[R]",  # 165
    "?",  # 166
]
# Keys that are set when the pattern fits on more different sets of atoms than this.
THRESHOLDS = {118: 1, 120: 1, 127: 1, 130: 1, 131: 1, 136: 1, 138: 1, 140: 3, 141: 2, 142: 1, 145: 1, 146: 2, 149: 1, 159: 1}
SIZE = 167  # bits; bit 0 is unused
UNDEFINED, AROMATIC_RINGS, FRAGMENTS = 1, 125, 166
