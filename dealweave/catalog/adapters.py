"""Deal-shaped views over the driver's tables, written once for Spark and DuckDB.

``{name}`` stands for a table or another view, ``ARR(...)`` for an array literal, ``JOINED(value, order)`` for an
ordered text aggregate. The driver's tables hold no NULLs, so some values are mapped to NULL by what they say
(for example a priority that is not specified).
"""

ADAPTERS: dict[str, str] = {
    # Deals: one per order.
    "deals": """
        select 'd' || cast(o_orderkey as STRING) as id,
          'https://deals.example/' || cast(o_orderkey as STRING) as url,
          case o_orderstatus when 'F' then c_name || ' Ltd' when 'P' then lower(c_name) || '.ai' else c_name end as deal,
          case o_orderstatus when 'F' then 'Pass' when 'O' then 'To be Passed' else 'Tracking' end as status,
          case o_orderpriority when '1-URGENT' then 'Deck Scan' when '2-HIGH' then 'First Call'
            when '3-MEDIUM' then 'Diligence' when '5-LOW' then 'NA' end as decision_to_pass_stage,
          nullif(c_mktsegment, 'MACHINERY') as f3_classification,
          case when o_orderpriority <> '5-LOW' then ARR(c_mktsegment, o_orderpriority) end as sectors,
          case when o_orderpriority <> '4-NOT SPECIFIED' then ARR(o_orderpriority, c_mktsegment) end as source,
          case when c_acctbal >= 0 then 'user-' || cast(c_nationkey as STRING) end as created_by,
          case when o_orderpriority <> '2-HIGH' then cast(o_orderdate as date) end as meeting_date,
          cast(o_orderdate as timestamp) as created_time,
          'Zone ' || cast(c_nationkey as STRING) as location,
          'Founder ' || cast(o_custkey as STRING) as founder_name,
          case when c_acctbal > 5000 then 'https://www.linkedin.com/in/P' || cast(o_custkey as STRING) || '?trk=1'
            when c_acctbal > 0 then '' end as founder_linkedin,
          cast(null as STRING) as previous_company,
          cast(o_totalprice as decimal(18,2)) as amount
        from {orders} join {customer} on c_custkey = o_custkey""",
    # Previous companies of a deal: the parts of the order as a comma-separated text.
    "deal_previous": """
        select 'd' || cast(l_orderkey as STRING) as id, JOINED(p_name, p_name) as previous_company_worked_at
        from {lineitem} join {part} on p_partkey = l_partkey group by l_orderkey""",
    "deals_full": """
        select d.*, p.previous_company_worked_at from {deals} d left join {deal_previous} p on p.id = d.id""",
    # The flat snapshot: one row per customer with four founder slots.
    "snapshot": """
        select 'c-' || cast(c_custkey as STRING) as id, 'https://snap.example/' || cast(c_custkey as STRING) as url,
          case when c_mktsegment = 'AUTOMOBILE' and c_acctbal > 3000 then 'Solo ' || c_name else c_name || ' Inc' end as deal, case when c_acctbal > 0 then 'Pass' else 'To be Passed' end as status,
          nullif(c_mktsegment, 'FURNITURE') as f3_classification,
          case when c_acctbal > 1000 then ARR(c_mktsegment) end as sectors,
          case when c_acctbal > 2000 then ARR('Referral') end as source,
          cast(case when c_acctbal > 3000 then '1997-06-15' when c_acctbal > 500 then '1999-01-01' end as date) as meeting_date,
          cast('2024-01-01 00:00:00' as timestamp) as source_created_time,
          case when c_acctbal > 4000 then 'Fund ' || cast(c_nationkey as STRING) || ', Angel ' || c_mktsegment || '; '
            when c_acctbal > 0 then 'Fund ' || cast(c_nationkey as STRING) end as institutional_funding,
          ' Founder ' || cast(c_custkey as STRING) as founder_1_name,
          case when c_acctbal > 0 then 'https://www.LinkedIn.com/in/F' || cast(c_custkey as STRING) || '?trk=1' end as founder_1_linkedin,
          'red widget, ' || c_mktsegment || ' Corp' as founder_1_previous_company_worked_at,
          'Head - R&D - ' || lower(c_mktsegment) || '; Analyst - Nation ' || cast(c_nationkey as STRING) || '; Advisor'
            as founder_1_designations,
          case when c_mktsegment <> 'BUILDING' then 'Lead ' || n_name end as founder_2_name,
          'linkedin.com/in/lead-' || lower(n_name) || '/' as founder_2_linkedin,
          case when c_acctbal > 6000 then 'old anvil; hot rod' end as founder_2_previous_company_worked_at,
          'Partner - ' || n_name as founder_2_designations,
          case when c_acctbal < 0 then 'Partner ' || cast(c_custkey as STRING) else '' end as founder_3_name,
          cast(null as STRING) as founder_3_linkedin, 'blue ring' as founder_3_previous_company_worked_at,
          'CFO - cold gear' as founder_3_designations,
          cast(null as STRING) as founder_4_name, ' ' as founder_4_linkedin,
          cast(null as STRING) as founder_4_previous_company_worked_at, cast(null as STRING) as founder_4_designations
        from {customer} join {nation} on n_nationkey = c_nationkey""",
    # Known companies with their other spellings.
    "companies": """
        select c_mktsegment as name, ARR(c_mktsegment || ' Corp', 'The ' || c_mktsegment) as aliases
        from {customer} where c_mktsegment <> 'FURNITURE' group by c_mktsegment
        union all
        select n_name as name, ARR('Nation ' || cast(n_nationkey as STRING)) as aliases from {nation}""",
    # Entity labels: one per part name.
    "entities": """
        select p_name as name,
          case when split_part(p_name, ' ', 1) <> 'large' then upper(split_part(p_name, ' ', 2)) end as entity,
          case when split_part(p_name, ' ', 1) = 'red' then 'Group ' || split_part(p_name, ' ', 2) end as parent_group,
          'maker' as entity_type,
          case split_part(p_name, ' ', 1) when 'red' then 'verified' when 'blue' then 'probable'
            when 'small' then 'unresolved' when 'old' then 'not_found' when 'hot' then 'unchecked' end as status,
          split_part(p_name, ' ', 2) || '.example' as domain
        from {part} group by p_name""",
    # Funding rounds: one per line item.
    "rounds": """
        select 'r' || cast(l_orderkey as STRING) || '-' || cast(l_linenumber as STRING) || '-' || cast(l_partkey as STRING)
            || '-' || cast(l_suppkey as STRING) as id,
          'https://rounds.example/' || cast(l_orderkey as STRING) as url,
          p_name || ' ' || p_brand || ' ' || p_type as company,
          case l_returnflag when 'A' then 'Series A' when 'R' then 'Seed' end as round_name,
          case p_type when 'ECONOMY' then 'Missing' when 'SMALL' then 'Missing' when 'STANDARD' then 'Passed earlier'
            when 'MEDIUM' then 'Pass' when 'PROMO' then 'Late' end as pipeline_state,
          case when p_size > 5 then ARR(case when p_size > 30 then 'FinTech' else 'Retail' end, p_type) end as sector,
          ARR(case when s_nationkey < 5 then 'Bengaluru' when s_nationkey < 9 then 'Mumbai'
            when s_nationkey < 12 then 'Gurugram' else 'Zone ' || cast(s_nationkey as STRING) end) as location,
          ARR('Fund ' || cast(s_nationkey as STRING)) as lead_investor,
          case when l_discount > 0 then ARR(s_name, 'Fund ' || cast(s_nationkey as STRING)) end as round_investors,
          case when l_linestatus = 'O' or l_returnflag <> 'N' then cast(l_shipdate as date) end as round_date,
          case when l_tax > 0 then cast(l_extendedprice as decimal(18,2)) end as round_amount_usd,
          1990 + p_size as founded_year
        from {lineitem} join {part} on p_partkey = l_partkey join {supplier} on s_suppkey = l_suppkey""",
    # Founder data of the funded companies.
    "company_people": """
        select p_name || ' ' || p_brand || ' ' || p_type as company, max(p_size) > 10 as found,
          case when max(p_size) > 20 then 'Person ' || min(p_brand) end as person,
          case when max(p_size) > 30 then 'CEO' end as designation,
          case when max(p_size) > 15 then 'cold gear' end as previous,
          case when max(p_size) > 25 then max(p_retailprice) > 1000 end as serial_founder
        from {part} group by p_name, p_brand, p_type""",
    # Companies funded without being seen, the sector master and the investors' missed deals.
    "out_of_coverage": """
        select 's' || cast(s_suppkey as STRING) as id, s_name || ' Pvt Ltd' as name,
          case when s_acctbal > 0 then 'New' end as status, 'Fund' as type, cast(null as STRING) as f2_classification,
          n_name as f3_classification, ARR('Supply') as sectors, ARR('List') as source,
          'Zone ' || cast(s_nationkey as STRING) as location, 'Angel' as investor_type,
          cast(null as STRING) as risk_evaluation, cast(null as STRING) as notes, cast(null as STRING) as similar_companies,
          'Owner of ' || s_name as founder_name, cast(null as STRING) as previous_companies_worked_at,
          cast('2024-01-02 00:00:00' as timestamp) as creation_date,
          'https://ooc.example/' || cast(s_suppkey as STRING) as url
        from {supplier} join {nation} on n_nationkey = s_nationkey""",
    "sector_master": """
        select 'm' || cast(c_custkey as STRING) as id, c_name as deal, c_mktsegment as f3_sector_classification,
          case when c_acctbal > 0 then 'Tracked' end as status,
          case when c_acctbal > 1000 then ARR('Fund ' || cast(c_nationkey as STRING)) end as investor,
          'Founder ' || cast(c_custkey as STRING) as founder_name, cast(null as STRING) as founder_linkedin,
          cast(null as STRING) as founder_previous_company,
          cast(case when c_acctbal > 2000 then '2023-05-01' end as date) as created_on,
          'https://master.example/' || cast(c_custkey as STRING) as url
        from {customer}""",
    "investor_missing": """
        select 'i' || cast(n_nationkey as STRING) as id, 'Fund ' || cast(n_nationkey as STRING) as investor,
          cast(count(*) as decimal(18,2)) as missing_deals, JOINED(s_name, s_name) as company_names,
          ARR(max(n_name)) as sectors, 'https://missing.example/' || cast(n_nationkey as STRING) as url
        from {nation} join {supplier} on s_nationkey = n_nationkey group by n_nationkey""",
    "investor_mix": """
        select 'b' || cast(s_suppkey as STRING) as id, s_name as company_name,
          nullif(count(case when p_type = 'ECONOMY' then 1 end), 0) as ai_software_and_infra,
          count(case when p_type = 'STANDARD' then 1 end) as b2b_and_manufacturing,
          count(case when p_type = 'PROMO' then 1 end) as india_consumption_1,
          count(case when p_type = 'SMALL' then 1 end) as india_consumption_2_3,
          nullif(count(case when p_type = 'MEDIUM' then 1 end), 0) as fintech_and_fs,
          count(case when p_type = 'LARGE' then 1 end) as deeptech,
          cast(null as bigint) as healthcare, count(*) as other,
          'https://mix.example/' || cast(s_suppkey as STRING) as url
        from {supplier} join {lineitem} on l_suppkey = s_suppkey join {part} on p_partkey = l_partkey
        group by s_suppkey, s_name""",
    # Leads and what notes say about their founders.
    "leads": """
        select 'l' || cast(c_custkey as STRING) as id,
          case when c_mktsegment = 'BUILDING' then 'Lead ' || cast(c_custkey as STRING) || ' (red widget)'
            else 'Lead ' || cast(c_custkey as STRING) end as company_name,
          case when c_acctbal > 0 then 'Open' end as status, 'High' as priority, 'Event' as source,
          'Zone ' || cast(c_nationkey as STRING) as location,
          case when c_acctbal > 5000 then 'Was at red widget before' end as description, 'Call' as next_action,
          'https://www.linkedin.com/in/l' || cast(c_custkey as STRING) as linkedin_url,
          case when c_acctbal > 8000 then 'Headline: Engineer at red widget' else 'No notes' end as body,
          'https://leads.example/' || cast(c_custkey as STRING) as url, ARR(c_mktsegment) as industry,
          ARR('https://deals.example/' || cast(c_custkey as STRING)) as deal_pipeline_mapping,
          cast('2023-12-01' as date) as created_date
        from {customer}""",
    "founder_history": """
        select 'd' || cast(l_orderkey as STRING) as deal_id, 'Dr. P' || cast(l_suppkey as STRING) || ' Person' as founder,
          p_name as company, case when l_returnflag = 'A' then 'Engineer' when l_returnflag = 'R' then '' end as role
        from {lineitem} join {part} on p_partkey = l_partkey
        union all
        select 'l' || cast(c_custkey as STRING), 'Lead ' || cast(c_custkey as STRING), 'red widget', 'Manager'
        from {customer} where c_acctbal < 0""",
    # Page content of the deals: an order's document.
    "content": """
        select 'd' || cast(d.doc_id as STRING) as page_id, 'Page ' || d.source as deal,
          case when d.lang <> 'de' then d.text end as transcript, case when d.lang <> 'fr' then d.text end as summary,
          case when d.lang = 'en' then '' when d.lang = 'de' then null else d.text end as meeting_notes,
          case when d.lang = 'es' then null else d.source end as page_notes, 1 as meetings,
          cast(e.ts as timestamp) as fetched_at
        from {documents} d join {events} e on e.event_id = d.doc_id""",
    # Usage log, runs, rules and feedback.
    "log": """
        select event_id as id, cast(ts as timestamp) as created_at, 'c' || cast(user_id as STRING) as client_id,
          case when event_type <> 'view' then 'u' || cast(user_id as STRING) || '@example.org' end as user_email,
          'Which ' || event_type || ' deals match ' || props || '?' as question,
          case when event_type <> 'error' then 'Found **Deal ' || cast(user_id as STRING) || '** for ' || props end as answer,
          case when event_type = 'error' then case when value > 60 then 'quota   exceeded for ' || props
            when value > 30 then 'API key not set' else 'unexpected token' end end as error,
          case event_type when 'purchase' then 1 when 'signup' then -1 end as rating,
          case when event_type = 'signup' and value > 20 then 'Use ' || props end as correction,
          case when event_type = 'signup' and value > 80 then 'approved' when event_type = 'signup' and value < 10 then 'dismissed'
            end as correction_status,
          cast(floor(value) as bigint) as row_count, cast(floor(value * 10) as bigint) as ms, 'model-a' as model,
          cast(floor(value * 3) as bigint) as tokens_in, cast(floor(value * 2) as bigint) as tokens_out
        from {events}""",
    "users": """
        select 'u' || cast(user_id as STRING) || '@example.org' as email, 'User ' || cast(user_id as STRING) as name
        from {events} group by user_id""",
    "runs": """
        select event_id as id, event_type as source, cast(ts as timestamp) as started_at, cast(ts as timestamp) as finished_at,
          cast(floor(value) as bigint) as rows_synced, value < 50 as ok,
          case when value < 25 then 'nightly: ' || props else 'manual ' || props end as error
        from {events}""",
    "rules": """
        select event_id as id, cast(ts as timestamp) as created_at, 'Rule for ' || props as rule,
          case when value > 40 then 'team correction approved by u' || cast(user_id as STRING) else 'manual' end as source,
          value < 60 as active
        from {events} where event_type = 'click'""",
    "feedback": """
        select l.doc_id as id, cast(e.ts as timestamp) as created_at, case when quality = 1 then 1 else -1 end as rating,
          case when toxic = 1 then 'team:u' || cast(user_id as STRING) else 'session' end as chat_id,
          d.text as question, d.text as answer, 'select ' || d.source as sql
        from {labels} l join {documents} d on d.doc_id = l.doc_id join {events} e on e.event_id = l.doc_id""",
    "insights": """
        select d.doc_id as id, cast(e.ts as timestamp) as created_at, d.lang || ' text of ' || d.source as title,
          d.text as insight, case when d.lang <> 'en' then d.source end as evidence,
          case when d.lang = 'en' then 'What about ' || d.source end as question, e.value < 60 as active
        from {documents} d join {events} e on e.event_id = d.doc_id""",
    # Searchable documents, their vectors and the questions asked.
    "docs": """
        select 'doc' || cast(doc_id as STRING) as id, source as kind, lang || ' ' || source as title, text as body,
          '{{"lang":"' || lang || '","name":"' || source || '","tags":["' || lang || '","' || source || '"]}}' as metadata
        from {documents}""",
    "vecs": """
        select d.id, d.kind, d.metadata, e.embedding
        from {embeddings} e join {docs} d on d.id = 'doc' || cast(e.vec_id as STRING)""",
    "asked": """
        select b.item_id as query_id, b.text, e.embedding as vector
        from {benchmark} b left join {embeddings} e on e.vec_id = b.item_id""",
}
