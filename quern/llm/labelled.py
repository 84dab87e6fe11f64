"""The small labelled table of problem 1: pages as sequences of flat text blocks, written for this project.

One line is one page, one item one block: its label (+ main body, - anything else), its element (h heading,
q quotation, code or caption, p paragraph, t row of a table, l list item, d any other container, m a
container whose parts stand between marks like | or ›), its number of words and, where some of them are
links, the share of linked text in percent; ``*n`` repeats a block. The pages follow common layouts: articles
in semantic markup, articles in plain containers, notices in paragraphs and lists, reference pages full of
links, shops, forums, pages that are nothing but menus.
"""

from __future__ import annotations

#: Labelled by hand.
PAGES = """
-d7:100 -d15 +h6 -d4 +p44 +p61 +h5 +p38 +p52 -d3:100 -l5:100*4 -d6 -d12
-m9:100 -d14 -m8 +h7 -d3 -d7 +p35 +p58 +h6 +p47 -d7:100 +p41 -d5 -d10
-l1:100*5 -d18 +h5 -d4 +p63 +h4 +t3*4 +p38 -d3:100 -l6:100*3 -m6:100 -d16
+h6 +p71 +p44 +l5 +l13 +l4 +l17 +l6 +p50 -d6 -d11
-d8:100 +h9 -d6 +p29 +p33 +q14 +p46 +p25 -l2:100 -l6:100*4 -d4
-m11:100 -m7 +h5 +p24 +h7 +p36 +l15 +l9 +l16 -d4:100 -d6 -d9:100
-d6:100 -d17 -d8 +h8 +p28 +p40 +q7 +p35 +h3 +t4*5 +p31 -l2:100 -l7:100*5 -d5 -d13
+h4 -d5 +p22 +p57 +p49 -d8
+h5 -d3 -d6 +p90 +p66 +h6 +p72 -d7 -d8 -d14
-d9:100 +h7 +p34 +l4*3 +l18 +l5 +p43 -l3:100 -l5:100*3 -d5 -d12 -d6:100
-l1:100 -l2:100 -l1:100*4 -d14 +h6 +p52 +t3*3 +p47 +q12 +p28 -d9 -m5:100
+h5 +p48 +l12 +l14 +l5 +l13 -l2:100 -l6:100*4 -d6
-m7:100 +h6 -d7 +p37 +q6 +p62 +p33 -d6:100 -d9 -d13
-d12 +h6 +p28 +p41 +h5 +p55 +h4 +p30 +h6 +p39 -d4 -d7:100
-d15 -d7:100 +h4 -d3 +p46 +l6 +l15 +l5*2 +l12 -d5:100 -l4:100*3 -m7:100
-m8 +h8 +p26 +h5 +t3*6 +h6 +t4*4 +p24 -d6 -d12
+h3 +p40 +p36 +q15 -d8:100 +p58 -d12 -d5
-d4 +h7 +p64 +p51 +l8 +l5 +l9 +p42 +h4 +l16*3 -l3:100 -l6:100*5 -d6 -d14
-d8:100 +h5 +d32 +d57 +d41 +d38 -d9 -d5:100
-l1:100*6 -d12 +h6 +d62 +d44 -d5:100 +d37 +d70 -d6 -d10
-d6 -d9:100 +d46 +d39 +d85 -d7 -d12
-m7:100 +h5 -d5 +d29 +d33 +d54 +d27 -l2:100 -l5:100*3 -d15
+d40 +d52 -l7 -l6
+d35 +d31 -l9 -l8
+d48 +d66 +d37 -l5 -l11
+h6 +d60 +d33 -l10 -l7
+d29 +d44 -l12 -l9 -l6
-l8 -l6 +d42 +d57
-l11 -l7 -l5 +h5 +d36 +d61 +d45
-l6 -l9 +h7 +p48 +p35 -l7 -l5
-p9:30 +h5 +p47 +p39 -p12:25 -p6:60
-p14 +h8 +p53 +p41 +p66 -p7:70 -p11:40
-p8:50 -l1:100*4 +h6 +p33 +p49 -p10:35
-p11:20 -d5:100 +h4 +p38 +l5 +l11 +l14 +p40 -p9:45 -p4:100
-d5 -p13:30 +h6 +p57 +p34 -l4:100*6 -p8:30
-m9:100 +h3 +p62:30 +p48:45 +p55:25 +l9:60 +l14:35 +p71:40 -d8:100 -d12
-l2:100*5 +h2 +p84:35 +p66:50 +h2 +p39:45 +p58:30 -l3:100*8 -p11:30
-d9:100 +h4 +p45:55 +p37:40 +d58:35 +d49:45 -d7 -l2:100*4
-l1:100*7 +h5 +p52:20 +q22 +p47:50 +p61:10 -l4:80*4 -d9:60
-d7:100 +h6 +d38:20 +d64:15 +d43:40 -d12:70 -d6:90 -d9
-d4:100 -d3 -d2:100 +h5 -d3 -d5 +d57 -d4:50 -d6 +d39 -d3:60 -d5 +d28 -d4:100 -d8
-l3:100*5 +h6 -d2 -d4 +d73 -d5:40 -d2 +d47 -d3:60 -d4 +d34 -d6:100
-d2:100*6 +h4 -d2 -d4:50 +p37 +h3 +l9 +l12 +l7 +h2 +t2*6 -d3:100*4 -d9:40
-m6:100 -d3 +h5 -d4 +p26 +t3*8 +p31 -l5:100*6 -d14:20
-d5:100 +h5 +p35 +t2*4 +h4 +l8 +l10 +l6 +p29 -d2:100 -l4:100*4 -p15:10
-l1:100*8 -l3:100*12 -d5 -d9:100
-d6:100 -l5:100*9 -d4 -l6:100*6 -d11
-m8:100 -d13 -l7:100*4 -d3 -l6:100*5 -d5 -d8:100 -d12
-d3:100 -d16 -d4:100 -d11 -d2 -d9:80
-l2:100*6 -d9 -d5 -d12:30 -d7:100 -d3
+h5 +q9 +q14 +p28 +q21 +p34 +h4 +q6 +p41 -d7:100
-l1:100*4 +h6 +p39 +q5 +q12 +q8 +p26 +h3 +p44 +q17 -d5 -l3:100*3
-d8:100 +h4 +p21 +q4 +p46 +q3 +q7 +p33 -m5:100 -d11
+h6 -d8 +p34 +p22 +p45 +p29 +p51 +p18 +p37 -d9 -d13:20
+h9 -d4 -d5 +p19 +p24 +p41 +p15 +p32 +h5 +p27 +p36 -l7:100*3 -d8
-d14 +h7 +p30 +p12 +p44 +p8 +p39 +p26 -d6:100 -d7 -d10
-m10:100 -d5 +h8 +p41 +p9 +p36 +q11 +p6 +p52 -d7 -d15
-d17 -m8:100 -m6 +h6 -d7:100 -d6 +p64 +p42 +p38 -d8 -d4:100 -l6:100*4 -d6 -d14
-d19 -m6:100 +h6 -d5 +p48 +p36 +h5 +p57 -d8 -d21
-d21 -l1:100*5 +h7 +p66 +p31 -l3:100 -l5:100*3 -d6 -d18
-d7:100 -d22 -m8 +h5 -d4 +p39 +l14 +l6 +p60 -d19
-d18 +h6 +p42 +t3*4 +p55 -d5:100 -d20 -m5:100
-d20 -d8:100 +d47 +d61 -d5 +d39 -l6:100*3 -d19
+h5 +p52 +p30 +p41
+h4 -d4 +p61 +h5 +p34
+h7 +p24 +p58 +p12
-m7 +h6 +p44 +h5 +p19
+p70 +p47 +p33
-d6:100 +h6 +p38 +q15
-d11 +h4 +p55 +p26 +q13
-m9:100 +h5 -m6 +p49 +p57 +h4 +p36
-m7:100 -d14 +h5 -m4 -d5 +p33 +p61 -l3:100 -l6:100*3 -d5 -d13
-d7 -m9 +h6 -m6 +p45 +h4 +p38 +l15 +l12 +p27 -d6 -d4 -m6:100
-m8:100 -m7 +h7 -m5 -d8 +p58 +t3*5 +p40 -m7:100 -d6 -d10
-m6:100 +h4 -m6:100 -d3 +p66 +p41 +l16 +l5 +l14 -d7 -d12
+h5 -d3 -m6 +p54 +h5 +t3*3 +p62 -m6:100 -d5 -d11 -m5:100
-d13 +h5 -d3 +p77 +p52 +h5 +p69 -d4:100 -d6 -d11 -m5:100
-m9:100 +h6 -d6 +p55 +l6 +l5 +l14 +l4 +l12 +p61 -d7 -l3:100 -l5:100*4 -d13
-d6:100 +h5 +p49 +l14 +l5*3 +l13 -l2:100 -l5:100*3 -d5 -d12
-d14 +h7 -d7 +p43 +t3*5 -d4:100 -l5:100*3 -m6:100
-m7 +h6 +p58 +l15 +l4 +l5 -d6 -d9
+h6 -d4:100 -d7 +p36 +q13 -d12 -m7:100
-d8:100 -m9 +h8 -d3 +p47 +p39 +h6 +p45 +h5 +p50 +l4 +l15 +l6 +p33 -d6 -d5:100
"""
