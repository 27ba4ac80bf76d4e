"""Weights of the tree model of html_extract, as its train() gives them: features, then edges by kind (00, 01, 10, 11)."""

MODEL = (
    [
        -0.28229225938961616,
        0.0,
        2.0143293419104897,
        -3.2551422793236404,
        1.6171189736797544,
        1.6759484907647824,
        0.0,
        0.0,
        0.0,
        0.0,
        0.0,
        0.0,
        -2.4324597562333055,
        0.0,
        0.0,
        0.0,
        1.3544560059415585,
        1.8970696773232947,
        -1.9337047112500065,
        -4.170131796289259,
        2.5335474875279207,
        2.0293955500918597,
        2.680970057761695,
        -0.7731303136031356,
        0.0,
        0.0,
        3.364091554256897,
        0.0,
        -0.022235057728775095,
        0.0,
        -1.0168074836373668,
        4.138985456365392,
        0.0,
        -0.48038629993137094,
        -0.019220171191392247,
        -1.436170389771037,
        1.332546769764992,
        0.0,
        0.3276302563094757,
        0.0,
        0.073125983525933,
        0.0,
        0.2962076658384824,
        0.0,
        0.2983525275343657,
        0.0,
        0.049411841260834866,
        0.2984751547196616,
        -1.8939494812777267,
        -0.13229285887893302,
        0.22442494576713343,
        0.7587438257387936,
        3.0442008393260758,
        0.0,
        0.8596123072244318,
        2.3205597177769217,
        -0.039020685188880924,
        -1.5710929593681764,
        -0.5534791185480936,
        0.7275455274449545,
        3.9053662680556913,
        -6.896375544834034,
        0.9064989452717764,
    ],
    [
        [0.5945162294039403, 1.013590015801444, 0.06452023339808038, 4.841768661601898],
        [2.873175914370514, 0.2188103968399711, 0.035113735898455734, 36.816737601631736],
        [0.9474356783268315, 15.001636000485236, 0.03726144739589329, 2.85737526602607],
        [20.33843186298342, 0.004010011903564522, 1.7515672798733837, 2.4856358086686954],
        [12.841322436085791, 0.004091436511500102, 0.5212776974331694, 35.99086347914934],
        [13.318564806166728, 0.0889970108145253, 0.7557961804503469, 0.9824982210550152],
        [12.114396232010888, 0.09536841587447975, 0.8260933040784941, 0.9457032841758605],
        [1.0, 1.0, 1.0, 1.0],
    ],
)
