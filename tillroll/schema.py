"""Table schemas and the fixed names used across the package."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_TRANSACTIONS = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.LongType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("UnitPrice", T.DoubleType()),
        T.StructField("CustomerID", T.StringType()),
        T.StructField("Country", T.StringType()),
    ]
)

CLEAN_TRANSACTIONS = T.StructType(
    RAW_TRANSACTIONS.fields
    + [
        T.StructField("TotalPrice", T.DoubleType()),
        T.StructField("DayOfWeek", T.IntegerType()),
        T.StructField("HourOfDay", T.IntegerType()),
    ]
)

# Feature column -> display name, in feature order.
FEATURE_LABELS = {
    "Sum_Quantity": "Tổng số lượng mua",
    "Mean_UnitPrice": "Giá trung bình",
    "Mean_TotalPrice": "Giá trị giao dịch TB",
    "Sum_TotalPrice": "Tổng chi tiêu",
    "Count_Invoice": "Số lần mua",
    "Count_Stock": "Số sản phẩm khác nhau",
    "Mean_InvoiceCountPerStock": "Tần suất mua/sản phẩm",
    "Mean_StockCountPerInvoice": "Sản phẩm/giao dịch",
    "Mean_UnitPriceMeanPerInvoice": "Giá TB/giao dịch",
    "Mean_QuantitySumPerInvoice": "Số lượng/giao dịch",
    "Mean_TotalPriceMeanPerInvoice": "Giá trị TB/giao dịch",
    "Mean_TotalPriceSumPerInvoice": "Tổng giá trị/giao dịch",
    "Mean_UnitPriceMeanPerStock": "Giá TB/sản phẩm",
    "Mean_QuantitySumPerStock": "Số lượng TB/sản phẩm",
    "Mean_TotalPriceMeanPerStock": "Giá trị TB/sản phẩm",
    "Mean_TotalPriceSumPerStock": "Tổng giá trị/sản phẩm",
}

FEATURES = list(FEATURE_LABELS)

# Axes of the six-axis radar profile.
RADAR_AXES_6 = {
    "Sum_Quantity": "Khối lượng mua",
    "Sum_TotalPrice": "Tổng chi tiêu",
    "Mean_UnitPrice": "Mức giá ưa thích",
    "Count_Invoice": "Tần suất mua",
    "Count_Stock": "Đa dạng sản phẩm",
    "Mean_TotalPriceSumPerInvoice": "Giá trị/giao dịch",
}

# The eight-axis profile adds two axes.
RADAR_AXES_8 = RADAR_AXES_6 | {
    "Mean_TotalPriceMeanPerStock": "Chi tiêu/sản phẩm",
    "Mean_StockCountPerInvoice": "Sản phẩm/giao dịch",
}

CUSTOMER_FEATURES = T.StructType(
    [T.StructField("CustomerID", T.StringType())]
    + [T.StructField(f, T.DoubleType()) for f in FEATURES]
)
