"""Edge rows for the raw invoice lines, one or more per cleaning decision."""

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"
UK, FR = "United Kingdom", "France"

ROWS = {
    "e1": f"581587,22613,PACK OF 20,12,2011-12-09 12:50:00,0.85,12680.0,{UK}",
    "e2": f"C536379,D,Discount,-1,2010-12-01 09:41:00,27.50,14527,{UK}",
    "e3": f"c536380,22960,JAM SET,1,2010-12-01 09:41:00,4.25,14527,{UK}",
    "e4": f",22961,JAM SET,1,2010-12-02 10:00:00,1.00,14527,{UK}",
    "e5": f"536414,22139,NA,56,2010-12-01 11:52:00,1.00,,{UK}",
    "e6": f"536370,22728,ALARM CLOCK,24,2010-12-01 08:45:00,3.75,12583,{FR}",
    "e7": f"536500,22729,ZERO PRICE,5,2010-12-03 08:00:00,0.0,14527,{UK}",
    "e8": f"536501,22730,ZERO QTY,0,2010-12-03 08:00:00,1.0,14527,{UK}",
    "e9": f"536502,22731,LONG ID,1,2010-12-04 23:59:00,1.0,1234567,{UK}",
    "e10": f"536503,22732,TWICE,2,2011-03-05 00:00:00,1.5,14527,{UK}",
    "e11": f"536503,22732,TWICE,2,3/5/2011 0:00,1.5,14527,{UK}",
    "e12": f"536504,,NO STOCK,1,2011-03-05 00:30:00,2.0,14527,{UK}",
    "e13": f'536505,22733,"CAFÉ, ""LARGE""",1,2011-12-08 12:51:00,2.0,15000,{UK}',
}


def write_raw(path) -> str:
    text = "\n".join([HEADER, *ROWS.values()]) + "\n"
    path.write_bytes(text.encode("ISO-8859-1"))
    return str(path)
