"""Content of STEP texts as sets of hashes."""

from brepflow.llm import content


def body(*statements: str) -> str:
    return "DATA;\n" + "\n".join(statements) + "\nENDSEC;\nEND-ISO-10303-21;"


def test_content_ignores_numbering_case_space_literals_and_number_formats():
    a = body("#1=CARTESIAN_POINT('a',(1.5,-0.25,0.));", "#2=LINE('',#1,2.E1);", "#3=PLANE('1.5',#2);")
    b = body("#7 = line ( 'x y', #00009 , 20.000000 ) ;", "#9=cartesian_point('b''c', /* 9.9 */ (\n1.500000 , -2.5E-1, -0.0));")
    x, y = content.ContentHasher()([a, b])
    assert len(x) == 2 and x.tolist() == y.tolist()


def test_content_differs_by_value_type_and_place():
    sets = content.ContentHasher()([body(s) for s in ("#1=P((1.,2.));", "#1=P((2.,1.));", "#1=Q((1.,2.));", "#1=P((1.,2.000001));", "#1=P((1.,2.0000001));")])
    assert len({x.tolist()[0] for x in sets}) == 4
    assert sets[0].tolist() == sets[4].tolist()


def test_content_of_nothing():
    assert [len(x) for x in content.ContentHasher()([None, "", body("#1=A(#2);"), body("#1=A('1.5');")])] == [0, 0, 0, 0]
