"""Record schemas, sink column orders and code dictionaries."""

from __future__ import annotations

# Schemas are DDL strings, so that this module needs no session.
PAGE_LOG = (
    "actions array<struct<action_id:string,item:string,item_type:string,ts:bigint>>, "
    "common struct<ar:string,ba:string,ch:string,is_new:string,md:string,mid:string,os:string,uid:string,vc:string>, "
    "displays array<struct<display_type:string,item:string,item_type:string,`order`:int,pos_id:int>>, "
    "page struct<during_time:bigint,item:string,item_type:string,last_page_id:string,page_id:string,source_type:string>, "
    "start map<string,string>, ts bigint"
)
# ts_ms and pos: when a change was made at its source, and where it stands in the source's log; null where a feed has neither.
CHANGE_EVENT = "database string, tableName string, before map<string,string>, after map<string,string>, type string, ts_ms bigint, pos bigint"
DEBEZIUM = "topic string, before map<string,string>, after map<string,string>, op string, ts_ms bigint, pos bigint"
ROUTE = "sourceTable string, operateType string, sinkType string, sinkTable string, sinkColumns string, sinkPk string, sinkExtend string"
ORDER_INFO = (
    "id bigint, province_id bigint, order_status string, user_id bigint, total_amount decimal(16,2), activity_reduce_amount decimal(16,2), "
    "coupon_reduce_amount decimal(16,2), original_total_amount decimal(16,2), feight_fee decimal(16,2), expire_time string, create_time string, operate_time string"
)
ORDER_DETAIL = (
    "id bigint, order_id bigint, sku_id bigint, order_price decimal(16,2), sku_num bigint, sku_name string, create_time string, "
    "split_total_amount decimal(16,2), split_activity_amount decimal(16,2), split_coupon_amount decimal(16,2)"
)
PAYMENT_INFO = "id bigint, order_id bigint, user_id bigint, total_amount decimal(16,2), subject string, payment_type string, create_time string, callback_time string"
CITIES = "pid int, pname string, cities array<struct<cname:string,lng:double,lat:double>>"

# Column orders of the positional sinks.
VISITOR_STATS = ["stt", "edt", "vc", "ch", "ar", "is_new", "uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum", "ts"]
PRODUCT_STATS = [
    "stt", "edt", "sku_id", "sku_name", "sku_price", "spu_id", "spu_name", "tm_id", "tm_name", "category3_id", "category3_name", "display_ct", "click_ct", "favor_ct",
    "cart_ct", "order_sku_num", "order_amount", "order_ct", "payment_amount", "paid_order_ct", "refund_order_ct", "refund_amount", "comment_ct", "good_comment_ct", "ts",
]
PROVINCE_STATS = ["stt", "edt", "province_id", "province_name", "province_area_code", "province_iso_code", "province_3166_2_code", "order_amount", "order_count", "ts"]
KEYWORD_STATS = ["keyword", "ct", "source", "stt", "edt", "ts"]
# Keyword weights by source, and codes that the jobs test.
KEYWORD_WEIGHTS = {"SEARCH": 10, "ORDER": 3, "CART": 2, "CLICK": 1}
GOOD_APPRAISE = "1201"
# The codes of the business records, by group.
CODES = {
    "order_status": {"1001": "unpaid", "1002": "paid", "1003": "cancelled", "1004": "finished", "1005": "refunding", "1006": "refunded"},
    "payment_type": {"1101": "alipay", "1102": "wechat", "1103": "unionpay"},
    "appraise": {"1201": "good", "1202": "medium", "1203": "bad", "1204": "automatic"},
    "refund_reason": {"1301": "bad goods", "1302": "wrong description", "1303": "sold out", "1304": "wrong size", "1305": "ordered by mistake", "1306": "no longer wanted", "1307": "other"},
    "coupon_status": {"1401": "unused", "1402": "in use", "1403": "used"},
    "refund_type": {"1501": "money only", "1502": "with goods"},
    "source_type": {"2401": "query", "2402": "promotion", "2403": "recommendation", "2404": "activity"},
    "activity_rule": {"3101": "amount off", "3102": "quantity discount", "3103": "discount"},
    "coupon_type": {"3201": "amount off", "3202": "quantity discount", "3203": "voucher"},
    "coupon_range": {"3301": "category", "3302": "trademark", "3303": "spu"},
}
