EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four five"), (5, "one two three four five"),
        (None, "one two three four five"), (6, "Ünï cödé, 日本 text's  double  blanks \n\n x"), (7, "w" * 5000),
        (8, " ".join("word%d" % (i % 700) for i in range(30000)))]
DIR = "/root/testdata/sf0.001"
