"""Weights of the semi-Markov field, written by pii_train."""

WEIGHTS: dict[str, float] = {
    'address|bare': -0.493,
    'address|bias': 1.640,
    'address|caps_word': 0.274,
    'address|cue:addr': 1.685,
    'address|cue:card': -0.722,
    'address|cue:name': 0.309,
    'address|cue:number': 0.099,
    'address|cue:phone': 0.376,
    'address|cut_words': -0.302,
    'address|english': 0.337,
    'address|flat': -0.188,
    'address|german': 0.324,
    'address|later_start': -3.392,
    'address|near:addr': 1.747,
    'address|near:card': -0.855,
    'address|near:phone': 0.332,
    'address|postal': 1.955,
    'address|street_word': 2.570,
    'email|bias': 0.618,
    'email|dotted': 0.618,
    'email|no_tld': -3.514,
    'email|spelled': 1.195,
    'email|tld': 2.211,
    'identity|card': 0.852,
    'identity|card_ok': -0.147,
    'identity|cue:card': 1.467,
    'identity|cue:name': 0.112,
    'identity|cue:number': 1.382,
    'identity|cue:pass': 1.218,
    'identity|cue:phone': 0.152,
    'identity|lower': 0.650,
    'identity|money_right': -1.527,
    'identity|near:card': 1.471,
    'identity|near:number': 1.386,
    'identity|near:pass': 1.219,
    'identity|near:phone': 0.103,
    'identity|nip': 2.393,
    'identity|no_series': -2.360,
    'identity|pass': 1.219,
    'identity|pesel': 2.492,
    'identity|upper': 1.101,
    'name|after_opening': 0.848,
    'name|bias': 0.245,
    'name|caps': -1.104,
    'name|cue:name': 0.229,
    'name|cut_at_line': -0.441,
    'name|cut_left:caps': -0.446,
    'name|cut_left:given': -2.246,
    'name|cut_left:initial': -0.556,
    'name|cut_left:odd': -1.236,
    'name|cut_left:other': -0.193,
    'name|cut_left:stop': -0.965,
    'name|cut_left:surname': 0.157,
    'name|cut_right:abbr': -1.157,
    'name|cut_right:caps': 0.445,
    'name|cut_right:initial': 0.109,
    'name|cut_right:odd': 0.282,
    'name|cut_right:other': -0.411,
    'name|cut_right:roman': -0.369,
    'name|cut_right:stop': -0.638,
    'name|cut_right:surname': -0.963,
    'name|cut_right:title': -0.716,
    'name|end2:ad': -0.212,
    'name|end2:ag': -0.167,
    'name|end2:aj': -0.471,
    'name|end2:ak': 1.030,
    'name|end2:al': -0.523,
    'name|end2:am': -0.152,
    'name|end2:an': 0.959,
    'name|end2:as': 0.229,
    'name|end2:ay': -0.238,
    'name|end2:ał': -0.286,
    'name|end2:ca': -0.585,
    'name|end2:ce': -0.327,
    'name|end2:ch': -0.306,
    'name|end2:ct': -0.229,
    'name|end2:cy': -0.076,
    'name|end2:cz': 0.584,
    'name|end2:da': 0.180,
    'name|end2:de': -0.122,
    'name|end2:ds': -0.184,
    'name|end2:dt': -0.150,
    'name|end2:ed': 0.518,
    'name|end2:ee': -0.111,
    'name|end2:ej': -0.358,
    'name|end2:ek': 0.835,
    'name|end2:el': 0.531,
    'name|end2:em': -0.113,
    'name|end2:en': 0.931,
    'name|end2:er': 0.558,
    'name|end2:es': 0.150,
    'name|end2:et': -0.281,
    'name|end2:ex': -0.315,
    'name|end2:eś': -0.077,
    'name|end2:ft': -0.128,
    'name|end2:ge': -0.167,
    'name|end2:gh': -0.187,
    'name|end2:go': -0.150,
    'name|end2:ht': -0.244,
    'name|end2:ia': 0.074,
    'name|end2:ie': -0.320,
    'name|end2:ig': -0.153,
    'name|end2:il': -0.314,
    'name|end2:im': -0.283,
    'name|end2:in': -0.132,
    'name|end2:is': 0.303,
    'name|end2:it': -0.243,
    'name|end2:ix': -0.080,
    'name|end2:ię': -0.127,
    'name|end2:ja': -0.384,
    'name|end2:ka': -0.236,
    'name|end2:ki': -0.120,
    'name|end2:ko': 0.436,
    'name|end2:ks': -0.188,
    'name|end2:kt': -0.071,
    'name|end2:la': -0.084,
    'name|end2:le': -0.150,
    'name|end2:lk': 0.214,
    'name|end2:ll': 0.193,
    'name|end2:ln': -0.164,
    'name|end2:ly': -0.156,
    'name|end2:lz': 0.218,
    'name|end2:ma': 0.387,
    'name|end2:me': -0.189,
    'name|end2:ms': -0.138,
    'name|end2:mt': -0.353,
    'name|end2:mu': -0.066,
    'name|end2:na': 0.335,
    'name|end2:nd': -0.127,
    'name|end2:ng': -0.443,
    'name|end2:ni': 0.585,
    'name|end2:nk': 0.095,
    'name|end2:nn': 0.258,
    'name|end2:nt': -0.319,
    'name|end2:ny': -0.757,
    'name|end2:ok': 0.138,
    'name|end2:on': 0.275,
    'name|end2:or': 0.526,
    'name|end2:os': 0.637,
    'name|end2:ov': 0.735,
    'name|end2:oé': 0.475,
    'name|end2:ra': -0.114,
    'name|end2:rd': -0.283,
    'name|end2:re': 0.386,
    'name|end2:rf': -0.202,
    'name|end2:rk': -0.070,
    'name|end2:rn': 0.566,
    'name|end2:ro': 0.223,
    'name|end2:rt': 0.647,
    'name|end2:se': -0.286,
    'name|end2:si': 0.239,
    'name|end2:su': -0.084,
    'name|end2:sé': 0.514,
    'name|end2:ta': -0.391,
    'name|end2:te': -0.266,
    'name|end2:th': 0.155,
    'name|end2:tu': -0.077,
    'name|end2:ty': -0.156,
    'name|end2:ud': -0.080,
    'name|end2:uk': 0.762,
    'name|end2:un': 0.062,
    'name|end2:ur': 0.241,
    'name|end2:us': 0.257,
    'name|end2:ut': -0.340,
    'name|end2:ve': -0.163,
    'name|end2:wa': -0.592,
    'name|end2:wn': 0.204,
    'name|end2:wo': -0.223,
    'name|end2:wy': -0.486,
    'name|end2:wę': -0.116,
    'name|end2:yk': 0.223,
    'name|end2:ym': -0.083,
    'name|end2:ył': -0.127,
    'name|end2:zy': -0.255,
    'name|end2:ák': 0.197,
    'name|end2:ía': 0.233,
    'name|end2:ąc': 0.238,
    'name|end2:ąd': -0.209,
    'name|end2:ła': -0.074,
    'name|end2:ар': 0.158,
    'name|end2:ат': -0.176,
    'name|end2:ач': -0.152,
    'name|end2:да': -0.111,
    'name|end2:ет': -0.100,
    'name|end2:ий': -0.712,
    'name|end2:ик': 0.291,
    'name|end2:ко': 0.529,
    'name|end2:кс': -0.103,
    'name|end2:на': 0.457,
    'name|end2:нк': -0.083,
    'name|end2:ні': -0.233,
    'name|end2:ок': -0.215,
    'name|end2:он': -0.071,
    'name|end2:ор': -0.223,
    'name|end2:ро': 0.416,
    'name|end2:уд': -0.129,
    'name|end2:ук': 0.306,
    'name|end2:ць': -0.184,
    'name|end2:ір': -0.168,
    'name|end2:ія': 0.462,
    'name|end3:aak': 0.126,
    'name|end3:act': -0.229,
    'name|end3:acy': -0.076,
    'name|end3:adt': -0.395,
    'name|end3:aek': 0.172,
    'name|end3:aer': 0.137,
    'name|end3:aft': -0.128,
    'name|end3:age': -0.167,
    'name|end3:amt': -0.353,
    'name|end3:ana': 0.757,
    'name|end3:ank': 0.095,
    'name|end3:ann': 0.258,
    'name|end3:ant': -0.186,
    'name|end3:aov': 0.193,
    'name|end3:ara': -0.063,
    'name|end3:ard': -0.133,
    'name|end3:are': -0.171,
    'name|end3:art': 0.150,
    'name|end3:ase': -0.286,
    'name|end3:ata': -0.176,
    'name|end3:auk': 0.128,
    'name|end3:aut': -0.139,
    'name|end3:ała': -0.074,
    'name|end3:bas': 0.113,
    'name|end3:ber': 0.141,
    'name|end3:bud': -0.080,
    'name|end3:był': -0.127,
    'name|end3:cht': -0.244,
    'name|end3:cik': 0.226,
    'name|end3:cja': -0.214,
    'name|end3:czy': -0.255,
    'name|end3:cía': 0.233,
    'name|end3:day': -0.238,
    'name|end3:der': -0.193,
    'name|end3:dok': -0.120,
    'name|end3:eak': 0.088,
    'name|end3:eek': 0.068,
    'name|end3:eer': 0.082,
    'name|end3:ego': -0.150,
    'name|end3:eil': -0.132,
    'name|end3:eim': -0.283,
    'name|end3:elk': 0.214,
    'name|end3:eme': -0.189,
    'name|end3:ent': -0.132,
    'name|end3:erk': 0.111,
    'name|end3:ern': 0.069,
    'name|end3:ers': 0.131,
    'name|end3:ert': 0.099,
    'name|end3:gan': -0.070,
    'name|end3:gor': 0.513,
    'name|end3:han': 0.163,
    'name|end3:his': -0.167,
    'name|end3:hus': 0.205,
    'name|end3:iaj': -0.256,
    'name|end3:iam': -0.152,
    'name|end3:iał': -0.065,
    'name|end3:ica': -0.088,
    'name|end3:ice': -0.282,
    'name|end3:icz': 0.584,
    'name|end3:idt': 0.244,
    'name|end3:iek': 0.167,
    'name|end3:ier': 0.198,
    'name|end3:ies': -0.113,
    'name|end3:ieś': -0.077,
    'name|end3:igh': -0.187,
    'name|end3:ill': 0.194,
    'name|end3:ima': 0.387,
    'name|end3:ing': -0.208,
    'name|end3:ini': 0.629,
    'name|end3:iov': 0.069,
    'name|end3:irt': 0.168,
    'name|end3:ith': 0.155,
    'name|end3:iuk': 0.134,
    'name|end3:ive': -0.163,
    'name|end3:jmu': -0.066,
    'name|end3:jny': -0.170,
    'name|end3:jąc': 0.238,
    'name|end3:ker': 0.240,
    'name|end3:kok': 0.073,
    'name|end3:kon': 0.097,
    'name|end3:ksu': -0.084,
    'name|end3:ler': 0.224,
    'name|end3:lia': 0.612,
    'name|end3:lis': 0.231,
    'name|end3:lna': -0.401,
    'name|end3:lny': -0.189,
    'name|end3:lor': 0.226,
    'name|end3:los': 0.458,
    'name|end3:lov': 0.065,
    'name|end3:loé': 0.475,
    'name|end3:lrt': 0.073,
    'name|end3:man': 0.572,
    'name|end3:med': 0.518,
    'name|end3:met': -0.083,
    'name|end3:mit': -0.243,
    'name|end3:mix': -0.080,
    'name|end3:mię': -0.093,
    'name|end3:mok': 0.161,
    'name|end3:mon': 0.068,
    'name|end3:nal': -0.131,
    'name|end3:nej': -0.098,
    'name|end3:ner': 0.079,
    'name|end3:nes': 0.248,
    'name|end3:nex': -0.126,
    'name|end3:nia': -0.211,
    'name|end3:nie': -0.244,
    'name|end3:nik': -0.356,
    'name|end3:nis': 0.101,
    'name|end3:nka': -0.063,
    'name|end3:nki': -0.109,
    'name|end3:nko': 0.436,
    'name|end3:nny': -0.195,
    'name|end3:nrt': 0.115,
    'name|end3:nyk': 0.223,
    'name|end3:nym': -0.071,
    'name|end3:oak': 0.146,
    'name|end3:ode': -0.122,
    'name|end3:oek': 0.207,
    'name|end3:oer': 0.177,
    'name|end3:ois': 0.222,
    'name|end3:ola': -0.084,
    'name|end3:ona': 0.183,
    'name|end3:oov': 0.126,
    'name|end3:ora': 0.271,
    'name|end3:ord': -0.149,
    'name|end3:orf': -0.202,
    'name|end3:ork': -0.181,
    'name|end3:ors': -0.114,
    'name|end3:ort': -0.092,
    'name|end3:osé': 0.514,
    'name|end3:ouk': 0.122,
    'name|end3:owa': -0.572,
    'name|end3:own': 0.204,
    'name|end3:owy': -0.445,
    'name|end3:owę': -0.099,
    'name|end3:pis': -0.134,
    'name|end3:ply': -0.156,
    'name|end3:por': -0.215,
    'name|end3:rag': -0.167,
    'name|end3:raj': -0.214,
    'name|end3:ral': -0.167,
    'name|end3:rds': -0.184,
    'name|end3:rej': -0.093,
    'name|end3:rek': 0.073,
    'name|end3:ria': -0.228,
    'name|end3:rik': 0.070,
    'name|end3:rin': -0.158,
    'name|end3:ris': 0.078,
    'name|end3:rka': -0.077,
    'name|end3:rks': -0.188,
    'name|end3:rms': -0.138,
    'name|end3:rna': -0.102,
    'name|end3:ros': 0.070,
    'name|end3:rre': 0.558,
    'name|end3:rta': -0.150,
    'name|end3:rty': -0.088,
    'name|end3:ruk': 0.099,
    'name|end3:san': 0.118,
    'name|end3:sek': -0.082,
    'name|end3:sen': 0.543,
    'name|end3:sie': -0.076,
    'name|end3:sja': -0.171,
    'name|end3:son': 0.168,
    'name|end3:ssi': 0.239,
    'name|end3:tee': -0.111,
    'name|end3:tek': 0.066,
    'name|end3:ter': -0.321,
    'name|end3:tet': -0.197,
    'name|end3:tex': -0.101,
    'name|end3:tro': 0.519,
    'name|end3:tte': -0.194,
    'name|end3:tuk': 0.075,
    'name|end3:tut': -0.202,
    'name|end3:two': -0.223,
    'name|end3:uak': 0.106,
    'name|end3:ual': -0.147,
    'name|end3:uch': -0.251,
    'name|end3:uda': 0.227,
    'name|end3:uek': 0.071,
    'name|end3:uer': 0.138,
    'name|end3:ule': -0.131,
    'name|end3:ulz': 0.218,
    'name|end3:und': -0.091,
    'name|end3:ung': -0.234,
    'name|end3:uov': 0.114,
    'name|end3:ura': -0.275,
    'name|end3:uro': -0.250,
    'name|end3:urt': 0.082,
    'name|end3:uta': -0.064,
    'name|end3:ute': -0.072,
    'name|end3:utu': -0.077,
    'name|end3:uuk': 0.084,
    'name|end3:vel': 0.547,
    'name|end3:vil': -0.182,
    'name|end3:vák': 0.197,
    'name|end3:wak': 0.192,
    'name|end3:wał': -0.220,
    'name|end3:wca': -0.495,
    'name|end3:wej': -0.076,
    'name|end3:wny': -0.176,
    'name|end3:yen': 0.417,
    'name|end3:yer': -0.354,
    'name|end3:zak': 0.160,
    'name|end3:zan': 0.069,
    'name|end3:zas': 0.065,
    'name|end3:zig': -0.153,
    'name|end3:zur': 0.241,
    'name|end3:ząd': -0.209,
    'name|end3:ßen': -0.086,
    'name|end3:öln': -0.212,
    'name|end3:ørn': 0.495,
    'name|end3:ład': -0.211,
    'name|end3:łem': -0.085,
    'name|end3:śna': -0.100,
    'name|end3:ада': -0.111,
    'name|end3:ана': 0.457,
    'name|end3:анк': -0.083,
    'name|end3:вач': -0.152,
    'name|end3:вір': -0.168,
    'name|end3:дні': -0.233,
    'name|end3:док': -0.215,
    'name|end3:екс': -0.103,
    'name|end3:ець': -0.184,
    'name|end3:кат': -0.176,
    'name|end3:кий': -0.199,
    'name|end3:кон': -0.071,
    'name|end3:лія': 0.462,
    'name|end3:ний': -0.508,
    'name|end3:ник': 0.291,
    'name|end3:нко': 0.529,
    'name|end3:суд': -0.129,
    'name|end3:тет': -0.100,
    'name|end3:тор': -0.223,
    'name|end3:тро': 0.416,
    'name|end3:чар': 0.158,
    'name|end3:чук': 0.306,
    'name|has:abbr': -1.677,
    'name|has:caps': -1.491,
    'name|has:given': 1.551,
    'name|has:initial': 1.472,
    'name|has:odd': -2.083,
    'name|has:other': 0.344,
    'name|has:roman': -1.270,
    'name|has:stop': -2.448,
    'name|has:surname': 0.487,
    'name|l:by': 0.071,
    'name|l:das': -0.121,
    'name|l:dem': -0.114,
    'name|l:dla': 0.061,
    'name|l:działa': -0.192,
    'name|l:freundlichen': -0.086,
    'name|l:is': 0.075,
    'name|l:ist': 0.083,
    'name|l:kierowała': 0.091,
    'name|l:kupił': 0.075,
    'name|l:miejscowości': -0.132,
    'name|l:nabyła': 0.075,
    'name|l:oraz': 0.092,
    'name|l:podstawie': -0.095,
    'name|l:reprezentują': 0.071,
    'name|l:the': -0.221,
    'name|l:to': 0.072,
    'name|l:von': 0.118,
    'name|l:w': -0.157,
    'name|l:was': 0.097,
    'name|l:złożyła': 0.091,
    'name|later': -0.519,
    'name|lcap': -0.376,
    'name|lend:a': -0.218,
    'name|lend:ar': 1.066,
    'name|lend:as': -0.419,
    'name|lend:at': 0.646,
    'name|lend:ax': -0.142,
    'name|lend:az': 1.439,
    'name|lend:ał': -0.385,
    'name|lend:b': -0.197,
    'name|lend:ba': -0.073,
    'name|lend:bq': -0.426,
    'name|lend:by': 1.445,
    'name|lend:bz': -0.162,
    'name|lend:ca': -0.170,
    'name|lend:ci': -2.188,
    'name|lend:cy': -0.341,
    'name|lend:d': -0.159,
    'name|lend:do': -0.679,
    'name|lend:ds': -0.086,
    'name|lend:dy': -0.343,
    'name|lend:ej': -0.281,
    'name|lend:ek': 0.491,
    'name|lend:em': -1.056,
    'name|lend:en': -1.680,
    'name|lend:go': 0.604,
    'name|lend:he': -2.022,
    'name|lend:ia': 0.619,
    'name|lend:ie': -1.218,
    'name|lend:is': 1.446,
    'name|lend:ię': 0.874,
    'name|lend:ją': 0.418,
    'name|lend:kt': 0.123,
    'name|lend:ku': -0.381,
    'name|lend:kł': -0.527,
    'name|lend:la': 1.166,
    'name|lend:ma': 0.182,
    'name|lend:mu': 0.765,
    'name|lend:na': -0.414,
    'name|lend:ng': 0.571,
    'name|lend:nk': 0.821,
    'name|lend:no': 1.032,
    'name|lend:ny': -0.125,
    'name|lend:om': 0.698,
    'name|lend:on': 1.670,
    'name|lend:qq': -0.192,
    'name|lend:ss': 0.528,
    'name|lend:st': 1.730,
    'name|lend:ta': -0.262,
    'name|lend:tb': -0.360,
    'name|lend:to': 1.148,
    'name|lend:w': -1.905,
    'name|lend:x': -0.192,
    'name|lend:y': -0.135,
    'name|lend:yx': -0.108,
    'name|lend:z': -0.787,
    'name|lend:zb': -0.070,
    'name|lend:zi': 0.379,
    'name|lend:ła': 0.852,
    'name|lend:ав': 0.604,
    'name|lend:до': -0.721,
    'name|lend:ла': 0.885,
    'name|lend:ід': -0.179,
    'name|line:2:given': 0.060,
    'name|line:2:other': 1.814,
    'name|line:2:stop': 0.475,
    'name|line:2:surname': 1.254,
    'name|line:3:other': -1.135,
    'name|line:3:surname': -0.370,
    'name|line_left': -0.693,
    'name|line_right': -0.441,
    'name|lsign:(': -0.389,
    'name|lsign:)': -0.304,
    'name|lsign:,': 0.511,
    'name|lsign:.': 0.100,
    'name|lsign:0': -0.324,
    'name|lsign:1': -0.493,
    'name|lsign:2': -0.323,
    'name|lsign:3': -0.140,
    'name|lsign:4': -0.403,
    'name|lsign:5': -1.134,
    'name|lsign:6': -0.379,
    'name|lsign:7': -0.600,
    'name|lsign:8': 0.273,
    'name|lsign:9': -0.542,
    'name|lsign::': 1.346,
    'name|lsign:none': 0.262,
    'name|lword': 0.638,
    'name|number_right': -1.518,
    'name|opens': -0.074,
    'name|r:agreed': 0.154,
    'name|r:appeared': 0.081,
    'name|r:bat': 0.072,
    'name|r:decision': -0.070,
    'name|r:do': -0.068,
    'name|r:does': 0.130,
    'name|r:entschieden': -0.121,
    'name|r:fragte': 0.102,
    'name|r:has': 0.187,
    'name|r:i': 0.086,
    'name|r:ist': 0.093,
    'name|r:jest': -0.183,
    'name|r:lachte': 0.126,
    'name|r:left': 0.067,
    'name|r:mieszka': 0.226,
    'name|r:moved': 0.135,
    'name|r:napisał': 0.098,
    'name|r:nr': -0.078,
    'name|r:o': 0.066,
    'name|r:oddalił': -0.460,
    'name|r:oddał': 0.103,
    'name|r:odmówił': -0.191,
    'name|r:odmówiła': 0.206,
    'name|r:odpisał': 0.106,
    'name|r:on': 0.144,
    'name|r:operierte': 0.119,
    'name|r:opuścił': 0.349,
    'name|r:orzeczono': -0.095,
    'name|r:pays': 0.064,
    'name|r:podpisał': -0.062,
    'name|r:potwierdza': 0.077,
    'name|r:potwierdził': 0.119,
    'name|r:prosi': -0.139,
    'name|r:przyszła': 0.093,
    'name|r:refuses': 0.175,
    'name|r:replied': -0.566,
    'name|r:sagte': -0.274,
    'name|r:signed': 0.086,
    'name|r:sold': 0.068,
    'name|r:spadł': -0.232,
    'name|r:stanowi': -0.088,
    'name|r:the': -0.079,
    'name|r:trwa': -0.091,
    'name|r:unterschrieben': 0.092,
    'name|r:ust': -0.063,
    'name|r:uznała': -0.084,
    'name|r:was': -0.271,
    'name|r:who': 0.078,
    'name|r:wies': -0.274,
    'name|r:wnosi': 0.200,
    'name|r:wohnt': 0.082,
    'name|r:wurde': -0.062,
    'name|r:wydano': 0.122,
    'name|r:wydał': -0.285,
    'name|r:wyjechał': 0.115,
    'name|r:wynika': -0.226,
    'name|r:wysłał': -0.264,
    'name|r:zapytał': 0.193,
    'name|r:zapłacił': 0.251,
    'name|r:zszedł': 0.211,
    'name|r:złożyła': -0.098,
    'name|r:виїхав': 0.071,
    'name|r:подав': 0.099,
    'name|r:підписав': -0.063,
    'name|rcap': -0.691,
    'name|rend:am': 0.846,
    'name|rend:an': -0.196,
    'name|rend:ar': 0.644,
    'name|rend:as': -0.294,
    'name|rend:at': 1.055,
    'name|rend:az': 0.998,
    'name|rend:ać': -0.497,
    'name|rend:ał': 0.384,
    'name|rend:ch': 0.684,
    'name|rend:ci': -0.866,
    'name|rend:ct': -0.223,
    'name|rend:cy': 0.480,
    'name|rend:da': 0.089,
    'name|rend:de': -0.780,
    'name|rend:do': -1.375,
    'name|rend:dł': -0.446,
    'name|rend:ec': -0.436,
    'name|rend:ed': 0.622,
    'name|rend:ek': -0.368,
    'name|rend:el': 0.182,
    'name|rend:em': -0.905,
    'name|rend:en': -0.514,
    'name|rend:er': -0.738,
    'name|rend:es': 0.151,
    'name|rend:ft': 1.313,
    'name|rend:go': -0.509,
    'name|rend:he': -1.550,
    'name|rend:ho': 1.337,
    'name|rend:i': 1.124,
    'name|rend:ia': 0.111,
    'name|rend:ie': 0.239,
    'name|rend:in': -0.727,
    'name|rend:it': -0.728,
    'name|rend:ić': -0.137,
    'name|rend:ię': -0.652,
    'name|rend:ił': -0.378,
    'name|rend:ją': -0.566,
    'name|rend:ka': -0.121,
    'name|rend:kł': 0.619,
    'name|rend:ld': 1.244,
    'name|rend:ll': -0.975,
    'name|rend:lt': 0.574,
    'name|rend:lu': -0.332,
    'name|rend:ly': -0.246,
    'name|rend:ma': -0.840,
    'name|rend:mu': -0.336,
    'name|rend:na': -1.147,
    'name|rend:ng': -0.130,
    'name|rend:nk': -0.262,
    'name|rend:no': -0.744,
    'name|rend:nr': -1.605,
    'name|rend:nt': 1.032,
    'name|rend:nu': -0.283,
    'name|rend:o': 1.210,
    'name|rend:og': 1.002,
    'name|rend:ok': 0.397,
    'name|rend:on': 0.184,
    'name|rend:or': 0.578,
    'name|rend:pl': 0.317,
    'name|rend:rd': -1.048,
    'name|rend:rt': 0.264,
    'name|rend:si': 0.357,
    'name|rend:st': -1.572,
    'name|rend:sł': 0.309,
    'name|rend:ta': -0.296,
    'name|rend:te': 1.069,
    'name|rend:to': -1.449,
    'name|rend:ts': 1.202,
    'name|rend:ty': -0.211,
    'name|rend:ut': 0.607,
    'name|rend:wa': -1.410,
    'name|rend:wi': -1.531,
    'name|rend:ys': 1.230,
    'name|rend:ył': -0.131,
    'name|rend:z': -0.270,
    'name|rend:za': 1.378,
    'name|rend:zi': -0.337,
    'name|rend:zy': -0.138,
    'name|rend:ła': 0.437,
    'name|rend:ży': -1.185,
    'name|rend:ав': 1.376,
    'name|rend:ве': 1.023,
    'name|rend:до': -0.130,
    'name|rend:ив': -0.248,
    'name|rend:не': -0.570,
    'name|rend:ов': -0.377,
    'name|rend:ок': -0.721,
    'name|rend:ра': 0.654,
    'name|rend:ся': 1.134,
    'name|rend:ід': -0.768,
    'name|rlast:c': -0.436,
    'name|rlast:d': 0.615,
    'name|rlast:e': 0.221,
    'name|rlast:g': 0.892,
    'name|rlast:h': 0.684,
    'name|rlast:k': -0.234,
    'name|rlast:l': -0.567,
    'name|rlast:m': -0.128,
    'name|rlast:n': -0.666,
    'name|rlast:o': -0.199,
    'name|rlast:s': 0.334,
    'name|rlast:t': 0.626,
    'name|rlast:u': -1.059,
    'name|rlast:y': -1.168,
    'name|rlast:z': 0.604,
    'name|rlast:ą': -0.566,
    'name|rlast:ć': -0.637,
    'name|rlast:ę': -0.671,
    'name|rlast:ł': 0.393,
    'name|rlast:а': 0.654,
    'name|rlast:в': 0.526,
    'name|rlast:д': -0.768,
    'name|rlast:е': 0.678,
    'name|rlast:к': -0.721,
    'name|rlast:о': -0.130,
    'name|rlast:я': 1.134,
    'name|rsign:(': 1.299,
    'name|rsign:,': 1.047,
    'name|rsign:-': 2.057,
    'name|rsign:.': -0.338,
    'name|rsign:/': -0.700,
    'name|rsign:0': 0.123,
    'name|rsign:1': -1.441,
    'name|rsign:2': -0.770,
    'name|rsign:3': -0.777,
    'name|rsign:4': -0.583,
    'name|rsign:5': -0.826,
    'name|rsign:6': -0.698,
    'name|rsign:7': -0.342,
    'name|rsign:8': -0.587,
    'name|rsign:9': -0.593,
    'name|rsign::': -1.536,
    'name|rsign:;': 0.317,
    'name|rsign:none': 1.585,
    'name|rword': 0.323,
    'name|script:cyrillic': -0.842,
    'name|script:latin': -0.649,
    'name|shape:caps+caps': -1.110,
    'name|shape:caps+caps+caps': -0.503,
    'name|shape:caps+caps+other': -0.104,
    'name|shape:caps+other': -0.337,
    'name|shape:given': -1.018,
    'name|shape:given+given': -1.189,
    'name|shape:given+given+other': 2.380,
    'name|shape:given+given+surname': 0.483,
    'name|shape:given+other': 1.381,
    'name|shape:given+other+abbr': -0.167,
    'name|shape:given+other+other': 0.746,
    'name|shape:given+other+stop': -0.300,
    'name|shape:given+other+surname': 0.225,
    'name|shape:given+stop': 0.383,
    'name|shape:given+surname': 1.686,
    'name|shape:given+surname+abbr': -0.272,
    'name|shape:given+surname+other': -2.505,
    'name|shape:given+surname+stop': -0.585,
    'name|shape:given+surname+surname': -0.382,
    'name|shape:initial': -0.456,
    'name|shape:initial+other': 1.783,
    'name|shape:initial+other+other': -0.745,
    'name|shape:initial+other+stop': -0.223,
    'name|shape:initial+surname': 0.907,
    'name|shape:odd+other': -1.898,
    'name|shape:odd+other+other': -0.241,
    'name|shape:odd+stop': -0.742,
    'name|shape:other': 0.369,
    'name|shape:other+abbr': -1.996,
    'name|shape:other+caps': -0.073,
    'name|shape:other+given': 0.081,
    'name|shape:other+given+given': -0.076,
    'name|shape:other+given+other': 0.894,
    'name|shape:other+given+surname': -0.428,
    'name|shape:other+initial': -0.470,
    'name|shape:other+initial+other': -0.935,
    'name|shape:other+initial+surname': -0.165,
    'name|shape:other+odd': -0.455,
    'name|shape:other+odd+other': -0.116,
    'name|shape:other+other': -0.179,
    'name|shape:other+other+abbr': -1.604,
    'name|shape:other+other+given': -1.615,
    'name|shape:other+other+initial': -0.225,
    'name|shape:other+other+other': -1.040,
    'name|shape:other+other+stop': -1.082,
    'name|shape:other+other+surname': -1.422,
    'name|shape:other+roman': -1.587,
    'name|shape:other+roman+abbr': -0.325,
    'name|shape:other+stop': -1.598,
    'name|shape:other+stop+other': -0.971,
    'name|shape:other+stop+stop': -0.613,
    'name|shape:other+stop+surname': -0.319,
    'name|shape:other+surname': -1.379,
    'name|shape:other+surname+given': -0.394,
    'name|shape:other+surname+other': -1.486,
    'name|shape:other+surname+stop': -0.740,
    'name|shape:other+surname+surname': -1.627,
    'name|shape:roman+abbr': -0.997,
    'name|shape:stop': -2.028,
    'name|shape:stop+given': -0.238,
    'name|shape:stop+given+other': -0.745,
    'name|shape:stop+given+surname': -0.153,
    'name|shape:stop+initial+other': -0.335,
    'name|shape:stop+other': -1.672,
    'name|shape:stop+other+given': -0.298,
    'name|shape:stop+other+other': -1.650,
    'name|shape:stop+other+stop': -0.133,
    'name|shape:stop+other+surname': -0.602,
    'name|shape:stop+stop': -2.174,
    'name|shape:stop+stop+other': -0.563,
    'name|shape:stop+stop+stop': -1.302,
    'name|shape:stop+stop+surname': -0.466,
    'name|shape:stop+surname': -1.650,
    'name|shape:stop+surname+other': -0.454,
    'name|shape:stop+surname+stop': -0.759,
    'name|shape:stop+surname+surname': -0.537,
    'name|shape:surname': 2.023,
    'name|shape:surname+given': 0.711,
    'name|shape:surname+given+other': 0.178,
    'name|shape:surname+other': -1.869,
    'name|shape:surname+other+other': -0.284,
    'name|shape:surname+stop': -1.779,
    'name|shape:surname+surname': -2.030,
    'name|street_left': -0.439,
    'name|title': 1.891,
    'name|title_single': -1.230,
    'name|w:act': -0.082,
    'name|w:administracyjny': -0.170,
    'name|w:agreement': -0.102,
    'name|w:altdorf': -0.071,
    'name|w:amtsgericht': -0.123,
    'name|w:annex': -0.126,
    'name|w:annual': -0.147,
    'name|w:beim': -0.104,
    'name|w:bergheim': -0.091,
    'name|w:biuro': -0.250,
    'name|w:board': -0.133,
    'name|w:building': -0.111,
    'name|w:buyer': -0.354,
    'name|w:bürgerliches': -0.273,
    'name|w:cegielnia': -0.126,
    'name|w:civil': -0.182,
    'name|w:code': -0.122,
    'name|w:committee': -0.111,
    'name|w:contract': -0.147,
    'name|w:cywilny': -0.189,
    'name|w:data': -0.176,
    'name|w:directors': -0.114,
    'name|w:dok': -0.120,
    'name|w:dolna': -0.072,
    'name|w:dzisiaj': -0.256,
    'name|w:dłużnik': -0.189,
    'name|w:executive': -0.163,
    'name|w:final': -0.131,
    'name|w:finanzamt': -0.114,
    'name|w:framework': -0.181,
    'name|w:fund': -0.091,
    'name|w:fundacja': -0.214,
    'name|w:general': -0.167,
    'name|w:gesellschaft': -0.128,
    'name|w:gminny': -0.195,
    'name|w:gospodarczy': -0.255,
    'name|w:grundbuch': -0.136,
    'name|w:grüßen': -0.086,
    'name|w:górka': -0.077,
    'name|w:górna': -0.102,
    'name|w:górnym': -0.071,
    'name|w:główny': -0.172,
    'name|w:handlowa': -0.174,
    'name|w:heute': -0.072,
    'name|w:high': -0.187,
    'name|w:huta': -0.064,
    'name|w:imię': -0.093,
    'name|w:instytut': -0.202,
    'name|w:jugendamt': -0.138,
    'name|w:kancelaria': -0.222,
    'name|w:klage': -0.167,
    'name|w:kodeksu': -0.084,
    'name|w:komisja': -0.168,
    'name|w:krajowa': -0.174,
    'name|w:köln': -0.086,
    'name|w:kündigung': -0.110,
    'name|w:landgericht': -0.120,
    'name|w:later': -0.346,
    'name|w:laut': -0.139,
    'name|w:lease': -0.130,
    'name|w:leipzig': -0.070,
    'name|w:leśna': -0.100,
    'name|w:mała': -0.074,
    'name|w:meeting': -0.077,
    'name|w:mieterin': -0.269,
    'name|w:ministerstwo': -0.220,
    'name|w:mit': -0.243,
    'name|w:mitte': -0.092,
    'name|w:musterstadt': -0.128,
    'name|w:nabywca': -0.167,
    'name|w:nabył': -0.127,
    'name|w:najmu': -0.066,
    'name|w:narodowy': -0.225,
    'name|w:neustadt': -0.094,
    'name|w:notarialna': -0.327,
    'name|w:notice': -0.118,
    'name|w:nowej': -0.076,
    'name|w:nowinki': -0.109,
    'name|w:oferta': -0.150,
    'name|w:olszanka': -0.063,
    'name|w:order': -0.162,
    'name|w:organ': -0.070,
    'name|w:parties': -0.113,
    'name|w:party': -0.088,
    'name|w:podpis': -0.111,
    'name|w:por': -0.215,
    'name|w:powiatowa': -0.144,
    'name|w:pozdrawiam': -0.152,
    'name|w:pracy': -0.076,
    'name|w:prokuratura': -0.245,
    'name|w:purchase': -0.142,
    'name|w:regards': -0.184,
    'name|w:report': -0.231,
    'name|w:rozdział': -0.065,
    'name|w:rozmawiałem': -0.085,
    'name|w:rzecznik': -0.198,
    'name|w:schedule': -0.131,
    'name|w:service': -0.100,
    'name|w:share': -0.151,
    'name|w:skarbowy': -0.183,
    'name|w:sprzedawca': -0.139,
    'name|w:standesamt': -0.100,
    'name|w:stara': -0.063,
    'name|w:starej': -0.093,
    'name|w:statutu': -0.077,
    'name|w:stowarzyszenie': -0.196,
    'name|w:supply': -0.156,
    'name|w:supreme': -0.189,
    'name|w:tenant': -0.186,
    'name|w:terms': -0.138,
    'name|w:this': -0.167,
    'name|w:today': -0.238,
    'name|w:trak': -0.078,
    'name|w:umowę': -0.099,
    'name|w:uniwersytet': -0.197,
    'name|w:urteil': -0.132,
    'name|w:versicherung': -0.114,
    'name|w:vertrag': -0.167,
    'name|w:wczoraj': -0.214,
    'name|w:wieś': -0.077,
    'name|w:wilkowice': -0.063,
    'name|w:wniosek': -0.082,
    'name|w:wola': -0.084,
    'name|w:works': -0.188,
    'name|w:wykonawca': -0.147,
    'name|w:zakład': -0.211,
    'name|w:zalesie': -0.076,
    'name|w:zarząd': -0.209,
    'name|w:zeznawał': -0.220,
    'name|w:адвокат': -0.176,
    'name|w:апеляційний': -0.072,
    'name|w:банк': -0.083,
    'name|w:верховний': -0.143,
    'name|w:господарський': -0.099,
    'name|w:директор': -0.223,
    'name|w:договір': -0.168,
    'name|w:закон': -0.071,
    'name|w:кодекс': -0.103,
    'name|w:комітет': -0.100,
    'name|w:кримінальний': -0.085,
    'name|w:міський': -0.100,
    'name|w:окружний': -0.092,
    'name|w:позивач': -0.152,
    'name|w:покупець': -0.184,
    'name|w:рада': -0.111,
    'name|w:свідок': -0.215,
    'name|w:суд': -0.129,
    'name|w:сьогодні': -0.233,
    'name|w:цивільний': -0.114,
    'phone|bias': 1.184,
    'phone|cue:addr': -0.486,
    'phone|cue:name': 0.231,
    'phone|cue:number': 0.818,
    'phone|cue:other': -1.458,
    'phone|cue:phone': 1.277,
    'phone|dashed': 1.292,
    'phone|dotted': -0.112,
    'phone|money_right': -2.837,
    'phone|near:addr': -0.575,
    'phone|near:name': 0.115,
    'phone|near:number': 0.809,
    'phone|near:other': -1.519,
    'phone|near:phone': 1.277,
    'phone|prefix': 1.592,
    'phone|solid': 1.016,
    'phone|spaced': 0.769,
}
