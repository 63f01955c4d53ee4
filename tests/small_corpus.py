"""Four source files whose answers are worked out by hand."""

FIXTURE = {
    "zmain": "REPORT zmain.\nDATA gv_one TYPE i.\nDATA: gv_two TYPE string, gv_three TYPE p.\nINCLUDE zinc.\nDATA(gv_four) = gv_inc + 1.\ngv_one = gv_four=>bad( ).\n"
    "FORM run USING p_in TYPE i.\n  DATA lv_local TYPE string.\n  lv_local = |{ p_in }|.\nENDFORM.\n",
    "zinc": "DATA gv_inc TYPE i.\nTYPES: BEGIN OF ty_line, key TYPE i, name TYPE string, END OF ty_line.\nDATA gs_line TYPE ty_line.\n",
    "zclass": "CLASS zcl DEFINITION.\n  PUBLIC SECTION.\n    CLASS-METHODS make RETURNING VALUE(r) TYPE REF TO zcl.\n    METHODS run IMPORTING i TYPE i.\n    DATA attr TYPE i READ-ONLY.\n"
    "  PRIVATE SECTION.\n    DATA hidden TYPE i.\nENDCLASS.\nCLASS zcl IMPLEMENTATION.\n  METHOD make. ENDMETHOD.\n  METHOD run. DATA x TYPE i. x = zcl=>make( ). ENDMETHOD.\nENDCLASS.\nDATA lo TYPE REF TO zcl.\n",
    "zdup": "TYPES t TYPE i.\nTYPES t TYPE string.\nthis is ( bad.\nINCLUDE zdup.\nINCLUDE znowhere.\n",
}


def fixture(spark):
    return spark.createDataFrame([(i + 1, n, t) for i, (n, t) in enumerate(sorted(FIXTURE.items()))], "file_id long, name string, content string")
